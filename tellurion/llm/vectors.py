"""What the two vector searches share: valid rows, equal vectors held once, queries in blocks, merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def valid(vec: Column, empty: bool = False) -> Column:
    """Neither null nor holding nulls, NaN or infinities; of no components only if `empty`."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vec.isNotNull() & (F.lit(empty) | (F.size(vec) > 0)) & ~F.coalesce(bad, F.lit(False))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """`rows`: id, vec.  Each vector once, with its `keep` smallest ids: no search result can need more.
    The ids are cut down to `keep` before the shuffle, so a vector that many rows have is no burden."""
    rank = F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= keep).groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def query_vectors(rows: DataFrame, is_query: Column) -> DataFrame:
    """The distinct vectors of the queries: vec and qkey, the smallest id of a query with that vector."""
    return rows.where(is_query).groupBy("vec").agg(F.min("id").alias("qkey"))


def packed(pdf: pd.DataFrame) -> dict:
    """Vectors and their ids as binary columns, for rows of one dimension."""
    vectors = np.array(list(pdf["vec"]), dtype="<f8")
    counts = [len(x) for x in pdf["ids"]]
    return {"n": len(pdf), "dim": vectors.shape[1], "vectors": vectors.tobytes(), "starts": np.cumsum([0, *counts]).astype("<i8").tobytes(), "ids": np.concatenate([np.asarray(x, dtype="<i8") for x in pdf["ids"]]).tobytes()}


class Best:
    """The `keep` best of each query so far: largest score first, ties to the smaller id.  Scores below a
    query's `floor` needn't be there."""

    def __init__(self, queries: int, keep: int, kind: type = np.float64, floor: np.ndarray | None = None):
        self.none = -np.inf if kind is np.float64 else np.iinfo(kind).min
        self.scores = np.full((queries, keep), self.none, dtype=kind)
        self.ids = np.full((queries, keep), np.iinfo(np.int64).max)
        self.floor = np.full(queries, self.none, dtype=kind) if floor is None else floor

    @property
    def worst(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)

    def add(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries `which` (rows) for rows with the given ids (columns)."""
        held = (scores >= self.worst[which, None]).any(axis=1)
        if not held.any():
            return
        which, scores = which[held], scores[held]
        keep = self.scores.shape[1]
        if scores.shape[1] > 4 * keep:  # only what can be among the best; ties all stay
            need = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
            some = (scores >= need[:, None]).any(axis=0)
            scores, ids = scores[:, some], ids[some]
        s = np.concatenate([self.scores[which], scores], axis=1)
        i = np.concatenate([self.ids[which], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((i, -s if s.dtype.kind == "f" else ~s), axis=1)[:, :keep]
        self.scores[which], self.ids[which] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def rows(self, qkeys: np.ndarray) -> pd.DataFrame:
        """What reaches the floors, for queries that have something."""
        live = [(s > self.none) & (s >= f) for s, f in zip(self.scores, self.floor, strict=True)]
        out = pd.DataFrame({"qkey": qkeys, "scores": [s[m] for s, m in zip(self.scores, live, strict=True)], "ids": [i[m] for i, m in zip(self.ids, live, strict=True)]})
        return out[[bool(m.any()) for m in live]]


FOUND = "qkey long, scores array<double>, ids array<long>"


def merged(found: DataFrame, keep: int) -> DataFrame:
    """Of each qkey the `keep` best of all that its searches found, in steps: a group of a step has a part of
    a part of them, however many searches there were."""
    best = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(c))), 1, keep)
    each = F.transform(F.arrays_zip("scores", "ids"), lambda x: F.struct((-x["scores"]).alias("minus"), x["ids"].alias("id")))
    part = found.select("qkey", each.alias("best"), F.xxhash64(F.col("scores"), F.col("ids")).alias("_h"))
    for parts in (4096, 64):
        part = part.groupBy("qkey", F.pmod("_h", F.lit(parts)).alias("_h")).agg(best(F.collect_list("best")).alias("best"))
    return part.groupBy("qkey").agg(best(F.collect_list("best")).alias("best"))


def ranked(best: DataFrame, rows: DataFrame, is_query: Column, queries: DataFrame, top: int) -> DataFrame:
    """The `top` best of every query row but its own, one row each: query_id, rank, vec_id, score."""
    asked = rows.where(is_query).select("id", "vec").distinct().join(queries, "vec").select(F.col("id").alias("query_id"), "qkey")
    found = asked.join(best, "qkey").select("query_id", F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, top).alias("best"))
    found = found.select("query_id", F.posexplode("best").alias("_p", "_b"))
    return found.select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_b.id").alias("vec_id"), (-F.col("_b.minus")).alias("score"))


def unpacked(vectors: bytes, starts: bytes, ids: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(vectors, dtype="<f8").reshape(-1, dim), np.frombuffer(starts, dtype="<i8"), np.frombuffer(ids, dtype="<i8")


def slots(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The rows of a task in pieces of `rows` rows of one dimension, in order."""
    held: dict[int, list[pd.DataFrame]] = {}
    for batch in batches:
        for dim, part in batch.groupby(batch["vec"].map(len), sort=True):
            held.setdefault(dim, []).append(part)
            if sum(map(len, held[dim])) >= rows:
                whole = pd.concat(held.pop(dim))
                while len(whole) >= rows:
                    yield whole.iloc[:rows]
                    whole = whole.iloc[rows:]
                if len(whole):
                    held[dim] = [whole]
    for dim in sorted(held):
        yield pd.concat(held[dim])
