"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For every prefix of a text exactly one token can be the last of the prefix's encoding.  It is the
token, among those an automaton finds ending there, whose predecessor (the last token of the prefix
in front of it) is compatible with it: merging the two tokens' texts from scratch gives the two tokens
back.  The table of last tokens is filled from left to right, the ids are read from it backwards.

A text is first cut where no vocabulary piece can cross, so that each unit is encoded by itself and
remembered.  Runs of blanks are a case of their own: their pieces all have one and the same score, so
merges go strictly from the left, which a stack does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_by_worker, small_batches

BLANK = "▁"
#: Units remembered by a Python worker, and the longest one remembered.
MEMO_UNITS, MEMO_CHARS = 180_000, 48


class PieceTables:
    """What encoding needs of a model, small enough to send to every worker (some MB for 32,000 pieces)."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        norm, train = spec.normalizer_spec, spec.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or train.treat_whitespace_as_suffix or any(p.type in (4, 5) for p in spec.pieces):
            raise ValueError("only BPE models with byte fallback, no normalisation and a blank in front are supported")
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.digest = hashlib.sha256(model).hexdigest()
        self.eos = sp.eos_id()
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.is_byte = [sp.is_byte(i) for i in range(n)]
        self.control = [sp.is_control(i) for i in range(n)]
        self.byte_id = {int(self.text[i][3:5], 16): i for i in range(n) if self.is_byte[i]}
        plain = [i for i in range(n) if not (self.is_byte[i] or self.control[i] or sp.is_unknown(i))]
        self.ids = {self.text[i]: i for i in plain}
        blanks = {i for i in plain if set(self.text[i]) == {BLANK}}
        self.runs = {len(self.text[i]): i for i in blanks}
        merged = sorted((i for i in plain if len(self.text[i]) > 1 and i not in blanks), key=lambda i: -sp.get_score(i))
        if len({sp.get_score(i) for i in merged}) < len(merged) or any(BLANK in self.text[i][1:] for i in merged):
            raise ValueError("pieces must have scores of their own and blanks only in front")
        if any(len(self.text[i]) > 1 and sp.get_score(i) >= sp.get_score(merged[-1]) for i in blanks):
            raise ValueError("runs of blanks must merge last")
        #: The order of merges; single characters are never merged into being.
        self.rank = [-1] * n
        for r, i in enumerate(merged):
            self.rank[i] = r
        self.by_text = {self.text[i]: self.rank[i] for i in merged}
        self.left, self.right = [-1] * n, [-1] * n
        self.tokens = [self.ids[c] for c in self.ids if len(c) == 1]
        for i in merged:
            if (parts := self._last_merge(self.text[i])) is not None:
                self.left[i], self.right[i] = parts
                self.tokens.append(i)
        self.pattern = self._cuts([self.text[i] for i in merged])

    def _last_merge(self, text: str) -> tuple[int, int] | None:
        """The two tokens whose merge gives the whole text, if merging it alone ends in one token."""
        parts = list(text)
        while len(parts) > 1:
            best = min((self.by_text.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 60:
                return None
            k = best[1]
            if len(parts) == 2:
                return self.ids.get(parts[0], -1), self.ids.get(parts[1], -1)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return None

    def _cuts(self, texts: list[str]) -> str:
        """A pattern whose matches no piece crosses: blanks, then runs of letters and runs of other
        characters, which stay together only where some piece joins the two characters at the border."""
        letters, joined = re.compile(r"[^\W\d_]"), set()
        for t in texts:
            body = t.lstrip(BLANK)
            joined |= {(a, b) for a, b in zip(body, body[1:], strict=False) if bool(letters.match(a)) != bool(letters.match(b))}
        run = rf"(?:[^\W\d_]+|(?:(?!{BLANK})[\W\d_])+)"
        border = "|".join(rf"(?<={re.escape(a)})(?={re.escape(b)})" for a, b in sorted(joined))
        more = rf"(?:(?:{border}){run})*" if border else ""
        return rf"{BLANK}*{run}{more}|{BLANK}+"


class PieceCodec:
    """Encodes and decodes with the tables; one for each worker process."""

    def __init__(self, tables: PieceTables):
        import ahocorasick

        self.t = tables
        self.find = re.compile(tables.pattern).findall
        self.automaton = ahocorasick.Automaton()
        for i in tables.tokens:
            self.automaton.add_word(tables.text[i], (i, len(tables.text[i])))
        self.automaton.make_automaton()
        self.known = {tables.text[i] for i in tables.tokens if len(tables.text[i]) == 1}
        self.size = [len(x) for x in tables.text]
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, tuple[str, int, str]] = {}
        self.shown = [None if b or c else x.replace(BLANK, " ") for x, b, c in zip(tables.text, tables.is_byte, tables.control, strict=True)]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b can follow token a: undo their merges, latest first, and see that at no
        time a merge across the border would have come before the merge undone last."""
        key = a << 20 | b
        if (known := self.pairs.get(key)) is not None:
            return known
        t, limit = self.t, 1 << 60
        rank, text, by_text = t.rank, t.text, t.by_text
        while True:
            if by_text.get(text[a] + text[b], 1 << 60) < limit:
                ok = False
                break
            if rank[a] > rank[b]:
                limit, a = rank[a], t.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, t.left[b]
            else:
                ok = True
                break
        if len(self.pairs) >= 1_000_000:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def _known(self, s: str) -> list[int]:
        """The ids of a text of known characters with at most one blank, at its start."""
        last, size, pairs, compatible = [-1] * (len(s) + 1), self.size, self.pairs, self.compatible
        for end, (token, length) in self.automaton.iter(s):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start == 0:
                last[end] = token
            elif (before := last[start]) >= 0:
                ok = pairs.get(before << 20 | token)
                if compatible(before, token) if ok is None else ok:
                    last[end] = token
        out, at = [], len(s)
        while at:
            out.append(token := last[at])
            at -= size[token]
        out.reverse()
        return out

    def _bytes(self, c: str) -> list[int]:
        return [self.t.byte_id[b] for b in c.encode()]

    def _text(self, s: str) -> list[int]:
        if self.known.issuperset(s):
            return self._known(s)
        out: list[int] = []
        at = 0
        for k, c in enumerate(s):
            if c not in self.known:  # it merges with nothing, so the text falls apart here
                out += self._known(s[at:k]) if k > at else []
                out += self._bytes(c)
                at = k + 1
        return out + (self._known(s[at:]) if at < len(s) else [])

    def _blanks(self, n: int) -> list[int]:
        runs, stack = self.t.runs, []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-1] + stack[-2] in runs:
                stack[-2:] = [stack[-1] + stack[-2]]
        return [runs[x] for x in stack]

    def unit(self, unit: str) -> list[int]:
        body = unit.lstrip(BLANK)
        blanks = len(unit) - len(body)
        if not body:
            return self._blanks(blanks)
        ids = self._text(BLANK * (blanks > 0) + body)
        if blanks < 2:
            return ids
        alone = ids[0] == self.t.runs[1]
        return self._blanks(blanks if alone else blanks - 1) + ids[alone:]

    def units(self, text: str) -> list[str]:
        return self.find(BLANK + text.replace(" ", BLANK)) if text else []

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        """The ids of a whole text (null: empty), with the end id last."""
        out = [i for u in self.units(text or "") for i in self.unit(u)]
        return out + [self.t.eos] if end else out

    def _surface(self, ids: list[int]) -> str:
        shown, out, raw = self.shown, [], bytearray()
        for i in ids:
            if (s := shown[i]) is None:
                if self.t.is_byte[i]:
                    raw.append(int(self.t.text[i][3:5], 16))
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            out.append(s)
        if raw:
            out.append(raw.decode(errors="replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; control ids give nothing, the blank in front is dropped."""
        return self._surface(ids).removeprefix(" ")

    def remembered(self, unit: str) -> tuple[str, int, str]:
        """Of a unit: its ids as decimal text, their number, and the text that they decode to."""
        if (got := self.memo.get(unit)) is None:
            ids = self.unit(unit)
            got = " ".join(map(str, ids)), len(ids), self._surface(ids)
            if len(unit) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_UNITS:
                    self.memo.clear()
                self.memo[unit] = got
        return got

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and SHA-256 of the decoded text."""
        parts = [self.remembered(u) for u in self.units(text or "")]
        ids = " ".join([p[0] for p in parts] + [str(self.t.eos)])
        back = "".join([p[2] for p in parts]).removeprefix(" ")
        return sum(p[1] for p in parts) + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def _codec(tables) -> PieceCodec:
    return held_by_worker(("pieces", tables.value.digest), lambda: PieceCodec(tables.value))


def load_tables(model_path: str) -> PieceTables:
    with open(model_path, "rb") as f:
        return PieceTables(f.read())


def encode_documents(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Adds `ids` (array of int, the end id last) to every row of `docs`.  Null texts count as empty.
    A column of that name is replaced."""
    tables = docs.sparkSession.sparkContext.broadcast(load_tables(model_path))

    @F.pandas_udf("array<int>")
    def encoded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(tables)
        for batch in texts:
            yield pd.Series([codec.encode(x) for x in batch])

    return docs.withColumn("ids", encoded(F.col(text)))


def decode_documents(docs: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded` (string) to every row of `docs`; null ids give null.  A column of that name is replaced."""
    tables = docs.sparkSession.sparkContext.broadcast(load_tables(model_path))

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(tables)
        for batch in batches:
            yield pd.Series([None if x is None else codec.decode(list(x)) for x in batch], dtype=object)

    return docs.withColumn("decoded", decoded(F.col(ids)))


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Of every row: doc_id, n_tokens, ids_sha256, decoded_sha256.  The rows stay where they are: there
    is no shuffle, and a lost task is computed anew from its input.  Repeated rows give repeated rows."""
    small_batches(docs.sparkSession)
    tables = docs.sparkSession.sparkContext.broadcast(load_tables(model_path))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(tables)
        for batch in texts:
            yield pd.DataFrame([codec.digest(x) for x in batch], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests(F.col("text")).alias("d")).select("doc_id", "d.*")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
