"""Token ids packed into rows of a fixed length, without loss.

Documents become ids, each with an end id.  Documents longer than a row are split into full rows and a
rest.  The pieces of a chunk are packed by best-fit decreasing: the longest first, each into the fullest
row that still holds it, which a segment tree over the rows' free space finds.  A chunk is what one task
has read, up to a bounded number of ids, so nothing is shuffled and a lost task is packed anew alike.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table


@dataclass(frozen=True)
class PackParams:
    """`row` ids a row; `chunk` ids are held by a task at most, and a document more."""

    row: int = 2048
    end: int = 50256
    chunk: int = 4_000_000


class SpaceTree:
    """A segment tree over the amounts of free space 0..row: the least amount of at least n that some
    row has."""

    def __init__(self, row: int):
        self.size = 1 << (row + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(row + 1)]

    def add(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        i = space + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The space and number of the fullest row with at least `least` free, which is taken out."""
        count, i = self.count, least + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        space = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return space, self.rows[space].pop()


def best_fit_decreasing(lengths: np.ndarray, row: int) -> list[list[int]]:
    """The pieces in each row.  No length is over `row`; ties go by the piece's number."""
    tree, packed = SpaceTree(row), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if (found := tree.take(n)) is None:
            space, at = row, len(packed)
            packed.append([])
        else:
            space, at = found
        packed[at].append(i)
        if space - n:
            tree.add(space - n, at)
    return packed


SHAPE = "pack_id long, n_tokens int, doc_ids array<long>, offsets array<long>, cu_seqlens array<int>, ids binary, positions binary"


def _packed(docs: list[tuple[object, np.ndarray]], params: PackParams, first: int) -> pd.DataFrame:
    pieces = [(k, at, ids[at : at + params.row]) for k, (_, ids) in enumerate(docs) for at in range(0, len(ids), params.row)]
    rows = []
    for n, members in enumerate(best_fit_decreasing(np.array([len(p[2]) for p in pieces], dtype=np.int64), params.row)):
        ids, places = np.full(params.row, params.end, dtype="<u2"), np.zeros(params.row, dtype="<u2")
        ends = np.cumsum([0] + [len(pieces[m][2]) for m in members])
        for m, a, b in zip(members, ends, ends[1:], strict=False):
            ids[a:b] = pieces[m][2]
            places[a:b] = np.arange(b - a)
        rows.append((first + n, int(ends[-1]), [docs[pieces[m][0]][0] for m in members], [pieces[m][1] for m in members], ends.tolist(), ids.tobytes(), places.tobytes()))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SHAPE.split(", ")])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, params: PackParams = PackParams()) -> DataFrame:
    """One row for each packed row of ids.

    ids: a row of the id matrix, `row` little-endian 16-bit numbers, filled up with the end id; n_tokens: how
    many of them count; cu_seqlens: where its pieces begin, and the end; positions: for each id its place
    in its piece, from 0 anew for every piece; doc_ids and offsets: whose ids a piece holds and from which
    of the document's ids on.  A null or empty text is its end id alone.  Rows with the same doc_id stay
    separate pieces.  Null doc_ids are kept as null.  pack_id is unique within a result.  A document longer than
    `chunk` makes a longer chunk of its own and is split over its rows like any; nothing is cut off.  Other
    columns take no part."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load_ranks(ranks_path))  # a vocabulary of a fixed size
    if params.end > 65535:
        raise ValueError("ids of 16 bits only")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        first, held, total = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                ids = np.array(encoding.encode_ordinary(text or "") + [params.end], dtype="<u2")
                held.append((None if pd.isna(doc_id) else int(doc_id), ids))
                total += len(ids)
                if total >= params.chunk:
                    out = _packed(held, params, first)
                    first, held, total = first + len(out), [], 0
                    yield from _parts(out)
        if held:
            yield from _parts(_packed(held, params, first))

    # Nulls make pandas hold the ids as floats, which can't hold all of them.
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(packed, SHAPE)


def _parts(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for k in range(0, len(rows), 500):
        yield rows.iloc[k : k + 500]


def write_packed(packed: DataFrame, path: str) -> None:
    """As Parquet by Spark's writer: one binary row of the id matrix each, readable from any store."""
    packed.write.parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """The documents' ids again: doc_id and ids (array of int, without the end id), for doc_ids of their own:
    pieces of rows with one doc_id come out behind one another."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for docs, offsets, cuts, ids in zip(batch["doc_ids"], batch["offsets"], batch["cu_seqlens"], batch["ids"], strict=True):
                row = np.frombuffer(ids, dtype="<u2").astype(np.int32)
                yield pd.DataFrame({"doc_id": pd.array(list(docs), dtype="Int64"), "at": offsets, "part": [row[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]})

    found = packed.mapInPandas(pieces, "doc_id long, at long, part array<int>")
    whole = found.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("ids"))
    return whole.withColumn("ids", F.slice("ids", 1, F.size("ids") - 1))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
