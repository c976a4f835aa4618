"""Near duplicates by improved consistent weighted sampling (ICWS) over TF-IDF word shingles.

1. Document frequencies of all shingles, in a table of a fixed size that shingles are hashed to.
2. Of each document: a fingerprint of its shingles with their counts, and samples drawn by ICWS, so that two
   documents agree in a sample with a probability that is their weighted Jaccard similarity.  Documents with
   one fingerprint are one node from here on.
3. The samples make bands; documents that share a band are candidates.  In a few turns each document is
   verified with its group's head, by the exact weighted Jaccard similarity of the whole texts; linked
   documents join classes.
4. In the groups that hold several classes after that, every two documents of different classes are compared,
   in blocks: a group's strangers with one another and with the whole of its largest class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_held, salted_join, small_batches, table, written
from .graphs import components


@dataclass(frozen=True)
class NearDupParams:
    words: int = 5
    similarity: float = 0.8
    bands: int = 16
    rows: int = 4
    #: log2 of the slots in a row of the table of document frequencies.
    slots: int = 20
    #: Turns in which documents are compared with one head each, before all that is left is compared.
    turns: int = 2
    #: Documents in a block, about.
    block: int = 128


#: Rows of the table of document frequencies: each hashes shingles anew.
ROWS = 2
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_EDGE = re.compile(r"[^0-9a-z\u0080-\U0010ffff]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of an odd number modulo 2**64, and of its inverse, as far as texts have needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, n.bit_length())
            base, inverse = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[np.uint64(1)], np.full(size, base, dtype=np.uint64)]).cumprod(dtype=np.uint64)
                self.down = np.concatenate([[np.uint64(1)], np.full(size, inverse, dtype=np.uint64)]).cumprod(dtype=np.uint64)
        return self.up, self.down


_powers = _Powers()
_WORD = np.zeros(256, dtype=bool)
_WORD[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True


def shingles(text: str | None, words: int) -> np.ndarray:
    """A hash of each run of `words` words (lower case; letters, digits and anything beyond ASCII).  A text
    with fewer words is one shingle; a text without words has none."""
    raw = np.frombuffer((text or "").lower().encode(), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = _WORD[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers.upto(len(raw) + 1)
    with np.errstate(over="ignore"):
        upto = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=upto[1:])
        each = _mix((upto[end] - upto[start]) * down[start])
        n = min(words, len(each))
        out = np.zeros(len(each) - n + 1, dtype=np.uint64)
        for k in range(n):
            out = out * _PRIME + each[k : k + len(out)]
        return _mix(out + np.uint64(n))


def slot(found: np.ndarray, row: int, slots: int) -> np.ndarray:
    """Where shingles are counted in a row of the table of document frequencies."""
    return ((found >> np.uint64(row * slots)) & np.uint64((1 << slots) - 1)).astype(np.int64)


class Weights:
    """TF-IDF weights of hashed shingles: (1 + ln tf) * idf.  idf = 1 + ln((1 + N) / (1 + df)) / ln(1 + N)
    lies between 1 and 2, so that a few rare words don't outweigh a text; N is the number of documents.

    df is the least of what a shingle's slots count, each less the mean of its row, which other shingles put
    there.  What lies within four standard deviations of that mean can't be told from chance: all shingles
    that are so rare get the same df, so that chance adds no weight of its own however large the corpus."""

    def __init__(self, table: np.ndarray, documents: int):
        n = max(documents, 1)
        mean = table.mean(axis=1, keepdims=True)
        df = np.clip(table - mean, np.maximum(1, 4 * np.sqrt(mean)), None)
        self.idf = (1 + np.log((1 + n) / (1 + np.minimum(df, n))) / np.log(1 + n)).astype(np.float32)
        self.slots = int(table.shape[1]).bit_length() - 1

    def of(self, text: str | None, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct shingles, their counts and weights."""
        found, tf = np.unique(shingles(text, words), return_counts=True)
        idf = np.maximum.reduce([row[slot(found, k, self.slots)] for k, row in enumerate(self.idf)])
        return found, tf, (1 + np.log(tf)).astype(np.float32) * idf


Weighted = tuple[np.ndarray, np.ndarray, np.ndarray]


def similar(x: Weighted, y: Weighted, similarity: float) -> bool:
    """Whether two texts' weighted Jaccard similarity is `similarity` at least."""
    (fa, _, wa), (fb, _, wb) = x, y
    _, ia, ib = np.intersect1d(fa, fb, assume_unique=True, return_indices=True)
    lower = np.minimum(wa[ia], wb[ib]).sum(dtype=np.float64)
    return bool(lower >= similarity * (wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - lower) - 1e-9)


def overlaps(texts: list[Weighted], left: np.ndarray, right: np.ndarray, columns: int = 2048) -> np.ndarray:
    """The weight that each of `left` shares with each of `right` (places in `texts`), to float precision.

    A shingle that is there k times counts as k, each with what it adds to the weight, so that the lesser of
    two weights is a product."""
    found, weight, at = [], [], []
    with np.errstate(over="ignore"):
        for i, (f, tf, w) in enumerate(texts):
            k = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf) + 1
            idf = np.repeat(w / (1 + np.log(tf)), tf)
            found.append(_mix(np.repeat(f, tf) + (k - 1).astype(np.uint64) * _PRIME))
            weight.append(idf * np.where(k > 1, np.log(k / np.maximum(k - 1, 1)), 1))
            at.append(np.full(len(k), i))
    _, column, count = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[column]
    column, at = (np.cumsum(shared) - 1)[column[keep]], np.concatenate(at)[keep]
    root = np.sqrt(np.concatenate(weight)[keep]).astype(np.float32)
    order = np.argsort(column, kind="stable")
    column, at, root = column[order], at[order], root[order]
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    for low in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(column, [low, low + columns])
        dense = np.zeros((len(texts), min(columns, int(shared.sum()) - low)), dtype=np.float32)
        dense[at[a:b], column[a:b] - low] = root[a:b]
        total += dense[left] @ dense[right].T
    return total


def links_of_blocks(ids: np.ndarray, classes: np.ndarray, side: np.ndarray, texts: list[Weighted], similarity: float) -> list[tuple[int, int]]:
    """Links that join all classes which any link joins between the documents of side 0 and those of side 1,
    or among those of side 0 if there is no other side."""
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    if not len(left):
        return []
    total = np.array([w.sum(dtype=np.float64) for _, _, w in texts])
    both = overlaps(texts, left, right)
    score = both / (total[left][:, None] + total[right][None, :] - both)
    near = (score >= similarity - 1e-3) & (classes[left][:, None] != classes[right][None, :])
    i, j = np.nonzero(near)
    found, least = [], {}

    def root(c: int) -> int:
        while (up := least.get(c, c)) != c:
            least[c] = least.get(up, up)
            c = up
        return c

    for k in np.argsort(-score[i, j], kind="stable"):
        a, b = left[i[k]], right[j[k]]
        p, q = root(classes[a]), root(classes[b])
        if p != q and similar(texts[a], texts[b], similarity):
            least[max(p, q)] = min(p, q)
            found.append((int(ids[a]), int(ids[b])))
    return found


class Sampler:
    """ICWS with `size` samples.  The two gamma variates and the uniform one of a shingle in a sample come
    from its hash, by tables of quantiles."""

    BITS = 12

    def __init__(self, size: int):
        rng = np.random.default_rng(20)
        n = 1 << self.BITS
        draws = np.sort(rng.gamma(2.0, size=(n, 64)).ravel())[32::64]
        self.gamma = draws.astype(np.float32)
        self.log_gamma = np.log(draws).astype(np.float32)
        self.salt = _mix(np.arange(1, size + 1, dtype=np.uint64) * _PRIME)

    def samples(self, found: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each sample a hash of the shingle drawn and its level."""
        low, few = np.uint64((1 << self.BITS) - 1), 512
        best, out = np.full(len(self.salt), np.inf, dtype=np.float32), np.zeros(len(self.salt), dtype=np.uint64)
        log_w = np.log(weight)
        with np.errstate(over="ignore"):
            for at in range(0, len(found), few):
                part, lw = found[at : at + few], log_w[at : at + few, None]
                h = (part[:, None] ^ self.salt[None, :]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xD6E8FEB86659FD93)
                r = self.gamma[((h >> np.uint64(52)) & low).astype(np.int32)]
                log_c = self.log_gamma[((h >> np.uint64(40)) & low).astype(np.int32)]
                beta = ((h >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
                level = np.floor(lw / r + beta)
                log_a = log_c - r * (level - beta + 1)
                pick = log_a.argmin(axis=0)
                k = np.arange(len(self.salt))
                less = log_a[pick, k] < best
                best = np.where(less, log_a[pick, k], best)
                out = np.where(less, _mix(part[pick] + (level[pick, k].astype(np.int64).astype(np.uint64) * _PRIME)), out)
        return out


def document_frequencies(docs: DataFrame, params: NearDupParams) -> tuple[np.ndarray, int]:
    """How many (document, distinct shingle) fall in each slot of each row of the table, over all documents,
    and the number of documents with words.  Tasks send blocks of slots; sums are made in two steps, so that
    no task holds more than a share of them.  The driver gets ROWS * 2**slots numbers, whatever the input."""
    size, block = 1 << params.slots, 1 << min(params.slots, 14)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(ROWS * size, dtype=np.int64), 0
        held: list[np.ndarray] = []

        def add() -> None:
            every = np.concatenate(held)
            for k in range(ROWS):
                total[k * size : (k + 1) * size] += np.bincount(slot(every, k, params.slots), minlength=size)
            held.clear()

        for batch in batches:
            for text in batch["text"]:
                if len(found := np.unique(shingles(text, params.words))):
                    n += 1
                    held.append(found)
                if len(held) >= 512:
                    add()
        if held:
            add()
        if n:
            parts = [total[k : k + block] for k in range(0, ROWS * size, block)]
            salt = int(total[:64].sum() % 32)
            yield pd.DataFrame({"block": range(len(parts)), "salt": salt, "n": [n] + [0] * (len(parts) - 1), "counts": [p.astype("<i8").tobytes() for p in parts]})

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(block, dtype=np.int64)
        for x in rows["counts"]:
            total += np.frombuffer(x, dtype="<i8")
        return pd.DataFrame({"block": [rows["block"][0]], "salt": [0], "n": [rows["n"].sum()], "counts": [total.tobytes()]})

    shape = "block int, salt int, n long, counts binary"
    parts = docs.select("text").mapInPandas(counted, shape)
    for keys in (("block", "salt"), ("block",)):
        parts = parts.groupBy(*keys).applyInPandas(summed, shape)
    got = parts.toPandas().sort_values("block")
    if not len(got):
        return np.zeros((ROWS, size)), 0
    return np.concatenate([np.frombuffer(x, dtype="<i8") for x in got["counts"]]).astype(float).reshape(ROWS, size), int(got["n"].sum())


def signatures(docs: DataFrame, shared: Broadcast, params: NearDupParams) -> DataFrame:
    """Of every row: doc_id, t (a hash of its text), node (16 bytes: the fingerprint of its shingles with
    their counts) and samples; the last two are null without words."""
    size = params.bands * params.rows

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_held()
        weights, sampler = shared.value, Sampler(size)
        for batch in batches:
            nodes, samples = [], []
            for text in batch["text"]:
                found, tf, w = weights.of(text, params.words)
                if not len(found):
                    nodes.append(None)
                    samples.append(None)
                    continue
                with np.errstate(over="ignore"):
                    both = _mix(found + tf.astype(np.uint64) * _PRIME)
                    nodes.append(both.sum().tobytes() + _mix(both + np.uint64(1)).sum().tobytes())
                samples.append(sampler.samples(found, w).astype("<u4").tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "t": batch["t"], "node": nodes, "samples": samples})

    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    return rows.mapInPandas(signed, "doc_id long, t long, node binary, samples binary")


def band_members(reps: DataFrame, params: NearDupParams) -> DataFrame:
    """band, h, node: the members of every band's groups of two or more."""
    part = lambda k: F.xxhash64(F.substring("samples", 1 + 4 * params.rows * k, 4 * params.rows))
    banded = reps.select("node", F.posexplode(F.array(*[part(k) for k in range(params.bands)])).alias("band", "h"))
    groups = banded.groupBy("band", "h").agg(F.count("*").alias("n")).where("n > 1").select("band", "h")
    return salted_join(banded, groups, ["band", "h"], "node", ways=4).select("band", "h", "node")


def mixed_groups(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of groups that hold several classes: band, h, node, class."""
    held = members.select("band", "h", "node").join(classes.withColumnRenamed("id", "node"), "node", "left")
    held = held.withColumn("class", F.coalesce("class", "node"))
    several = held.groupBy("band", "h").agg(F.min("class").alias("p"), F.max("class").alias("q")).where("p <> q").select("band", "h")
    return salted_join(held, several, ["band", "h"], "node")


def head_pairs(mixed: DataFrame, turn: int, params: NearDupParams) -> DataFrame:
    """One pair for each document outside its group's head's class: a, b (the head) and salt.

    A group's head is its first in an order that is the same for all groups and new in each turn.  Of a
    document's heads that one is taken with which it shares the most bands.  salt deals a head's pairs to
    keys of about `params.block` each."""
    groups = mixed.groupBy("band", "h").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(turn)), F.col("node").alias("b"), F.col("class").alias("of"))).alias("head"))
    pairs = salted_join(mixed, groups, ["band", "h"], "node").where(F.col("class") != F.col("head.of")).select(F.col("node").alias("a"), F.col("head.b").alias("b"), "n")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("bands"), F.max("n").alias("n"))
    best = pairs.groupBy("a").agg(F.max(F.struct("bands", "n", "b")).alias("m")).select("a", "m.b", F.ceil(F.col("m.n") / params.block).alias("ways"))
    return best.select("a", "b", F.pmod(F.xxhash64("a", F.lit(9)), F.col("ways")).alias("salt"))


def verified(pairs: DataFrame, texts: DataFrame, shared: Broadcast, params: NearDupParams) -> DataFrame:
    """The links among `pairs` (a, b, salt): a and b of those whose similarity is high enough.  A head's text
    is there once for each of its salts, so a head that many pairs have isn't one key."""

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, last = shared.value, (None, None)
        for batch in batches:
            keep = []
            for x, y in zip(batch["text_a"], batch["text_b"], strict=True):
                if y is not last[0] and y != last[0]:
                    last = (y, weights.of(y, params.words))
                keep.append(similar(weights.of(x, params.words), last[1], params.similarity))
            yield batch.loc[keep, ["a", "b"]]

    of = lambda end: texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}"))
    heads = pairs.select("b", "salt").distinct().join(of("b"), "b")
    return pairs.join(of("a"), "a").join(heads, ["b", "salt"]).select("a", "b", "text_a", "text_b").mapInPandas(checked, "a binary, b binary")


def jobs(mixed: DataFrame, params: NearDupParams) -> DataFrame:
    """Every two members of one group and of different classes, as jobs of two blocks: job, side, node, class.

    A group's strangers are its members outside its largest class.  They are compared with one another, group
    by group (groups of the same strangers are one), and with the whole of that class, class by class: a
    class that is the largest of many groups is compared once.  Members of the largest class aren't compared
    with one another.  Blocks hold about `params.block` documents; rows are narrow and no pair is a row."""
    block = params.block
    of_class = mixed.groupBy("band", "h", "class").agg(F.count("*").alias("n"))
    largest = of_class.groupBy("band", "h").agg(F.max(F.struct("n", "class")).alias("m")).select("band", "h", F.col("m.class").alias("main"))
    held = written(salted_join(mixed, largest, ["band", "h"], "node"), "mixed")
    strangers = held.where(F.col("class") != F.col("main"))

    def in_blocks(rows: DataFrame, count: DataFrame, name: str) -> DataFrame:
        return salted_join(rows, count, ["main"], "node").withColumn(name, F.pmod(F.xxhash64("node", F.lit(3)), F.col(f"n_{name}")))

    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # Strangers with the class: blocks i of the strangers and j of the class.
    asks = strangers.select("main", "node", "class").distinct()
    own = held.where(F.col("class") == F.col("main")).select("main", "node", "class").distinct()
    blocks = lambda rows, name: rows.groupBy("main").agg(F.ceil(F.count("*") / block).alias(name))
    count = written(blocks(asks, "n_i").join(blocks(own, "n_j"), "main"), "blocks")
    left = in_blocks(asks, count, "i").withColumn("j", F.explode(upto("n_j"))).withColumn("side", F.lit(0))
    right = in_blocks(own, count, "j").withColumn("i", F.explode(upto("n_i"))).withColumn("side", F.lit(1))
    with_class = left.unionByName(right).select(F.xxhash64(F.lit("class"), "main", "i", "j").alias("job"), "side", "node", "class")
    # Strangers with strangers: block i with block j, i <= j.
    several = strangers.groupBy("band", "h").agg(F.count("*").alias("n"), F.min("class").alias("p"), F.max("class").alias("q"), *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)])
    several = several.where("p <> q").groupBy("n", "x1", "x2").agg(F.min(F.struct("band", "h")).alias("g")).select("g.*", F.ceil(F.col("n") / block).alias("blocks"))
    among = salted_join(strangers.drop("main"), several, ["band", "h"], "node").withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")))
    among = among.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    among = among.withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    among = among.select(F.xxhash64(F.lit("group"), "band", "h", F.least("own", "other"), F.greatest("own", "other")).alias("job"), "side", "node", "class")
    return with_class.unionByName(among)


def compared(rows: DataFrame, texts: DataFrame, shared: Broadcast, params: NearDupParams) -> DataFrame:
    """The links that `jobs` find: a, b.  A task reads its jobs one after the other."""
    rows = written(rows, "jobs").join(texts.select("node", "text"), "node")
    rows = rows.repartition("job").sortWithinPartitions("job")

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, kept = shared.value, None

        def of(job: pd.DataFrame) -> list[tuple[bytes, bytes]]:
            if job["class"].nunique() < 2:
                return []
            texts = [weights.of(x, params.words) for x in job["text"]]
            classes = np.unique(job["class"].to_numpy(), return_inverse=True)[1]
            links = links_of_blocks(np.arange(len(job)), classes, job["side"].to_numpy(), texts, params.similarity)
            nodes = job["node"].to_numpy()
            return [(nodes[a], nodes[b]) for a, b in links]

        for batch in batches:
            batch = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            ends = np.flatnonzero(np.diff(batch["job"].to_numpy())) + 1
            for a, b in zip([0, *ends], ends, strict=False):
                yield pd.DataFrame(of(batch.iloc[a:b]), columns=["a", "b"], dtype=object)
            kept = batch.iloc[ends[-1] if len(ends) else 0 :]
        if kept is not None:
            yield pd.DataFrame(of(kept), columns=["a", "b"], dtype=object)

    return rows.mapInPandas(found, "a binary, b binary")


def joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """`classes` (id, class) with further links between them: components of classes, not of all documents."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(classes.select(F.col("id").alias(end), F.col("class").alias(f"c{end}")), end, "left")
    of_class = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    of_class = written(of_class.select(F.col("id").alias("class"), F.col("class").alias("_least")), "of-class")
    moved = salted_join(classes, of_class, ["class"], "id", "left").select("id", F.coalesce("_least", "class").alias("class"))
    alone = of_class.join(classes.select(F.col("id").alias("class")), "class", "left_anti")
    return moved.unionByName(alone.select(F.col("class").alias("id"), F.col("_least").alias("class")))


def near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """One row for each row of `docs`: doc_id and class, the smallest doc_id of its class.

    Documents are of one class if links of a similarity of at least `params.similarity` lead from one
    to the other.  Null texts and texts without words are classes of their own.  Rows with the same doc_id
    are the same document; if their texts differ, links from any of them count.  Rows without a doc_id
    have a null class and link no others.  Other columns take no part."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = spark.sparkContext.broadcast(Weights(*document_frequencies(docs, params)))  # ROWS * 2**slots numbers
    signs = written(signatures(docs, shared, params), "signs")
    # Texts with equal fingerprints are one node.  Minima are taken on the map side: no group is gathered.
    named = signs.where("node is not null and doc_id is not null")
    reps = named.groupBy("node").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "t", "samples")).alias("m"))
    reps = written(reps.select("node", "copies", "m.*"), "reps")
    # A doc_id with several texts links their nodes.
    same = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    same = named.join(same, "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    classes = written(components(same), "classes")
    members = written(band_members(reps, params), "members")
    needed = members.select("node").distinct().join(reps.select("node", "doc_id", "t"), "node")
    texts = docs.withColumn("t", F.xxhash64("text")).join(needed, ["doc_id", "t"]).groupBy("node").agg(F.min("text").alias("text"))
    texts = written(texts, "texts")

    # Turns that only save work: most links are found by one comparison a document.
    for turn in range(params.turns):
        pairs = written(head_pairs(mixed_groups(members, classes), turn, params), "pairs")
        if not pairs.take(1):
            break
        classes = written(joined(classes, written(verified(pairs, texts, shared, params), "linked")), "classes")
    # What decides: no two documents of one group and of different classes stay without comparison.
    left = written(mixed_groups(members, classes), "left")
    classes = written(joined(classes, written(compared(jobs(left, params), texts, shared, params), "compared")), "classes")

    of_node = reps.select("node", "copies", "doc_id").join(classes.withColumnRenamed("id", "node"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = of_node.groupBy("class").agg(F.min("doc_id").alias("least"))
    of_node = written(salted_join(of_node, least, ["class"], "node").select("node", "copies", F.col("least").alias("class")), "of-node")
    # At most 1,000 texts make up more than a thousandth of all rows: they go to every task, the others by shuffle.
    many = of_node.where(F.col("copies") > max(1000, signs.count() // 1000)).select("node", "class")
    rows = signs.select("doc_id", "node").where("node is not null and doc_id is not null")
    often = rows.join(F.broadcast(many), "node")
    rest = rows.join(F.broadcast(many), "node", "left_anti").join(of_node.select("node", "class"), "node")
    alone = signs.where("node is null or doc_id is null").select("doc_id", F.col("doc_id").alias("class"))
    return often.unionByName(rest).select("doc_id", "class").unionByName(alone)


def keep_one(docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """The rows of `docs` that stand for their class: one row for each class.  Rows without words or doc_id
    are kept.  Among rows with the doc_id that stands for a class, the one with the least text is kept.
    All columns stay, whatever their names."""
    classes = near_duplicates(docs, params).where("doc_id is not null and doc_id = class").select("doc_id").distinct()
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = whole.join(classes, "doc_id", "left_semi")
    kept = kept.groupBy("doc_id").agg(F.min_by("_row", F.struct(F.col("text").isNull(), "text", F.xxhash64("_row"))).alias("_row"))
    return kept.select("_row").unionByName(whole.where("doc_id is null").select("_row")).select("_row.*")


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
