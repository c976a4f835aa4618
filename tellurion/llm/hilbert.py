"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected onto a few orthogonal directions, shifted and put in the order of a Hilbert curve;
each of several curves has directions and shifts of its own.  Spark partitions the rows by ranges of the
curve's key.  A query is compared with the rows of the partitions around its own place on each curve;
what the curves find is merged and ranked by the exact measure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .vectors import FOUND, Best, distinct_vectors, merged, packed, query_vectors, ranked, slots, unpacked, valid


@dataclass(frozen=True)
class HilbertParams:
    """`window`: the share of all rows that a query meets on each curve.  Vectors without any structure
    need this much for a recall of 0.9; the share doesn't depend on the number of rows."""

    curves: int = 6
    dims: int = 3
    bits: int = 10
    window: float = 0.2
    block: int = 2048


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (one row each, `bits` bits a column), by undoing the curve's
    turns from the coarsest level to the finest and writing the bits of all columns in turn."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            turn = (x[i] & bit) > 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turn, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> level) & 1
    return key


def _frame(curve: int, dim: int, params: HilbertParams) -> tuple[np.ndarray, np.ndarray]:
    """The directions and shifts of a curve; the directions of different curves are orthogonal as far as
    there are enough of them."""
    rng = np.random.default_rng(dim)
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    shifts = rng.random((params.curves, params.dims))
    return turn[:, [(curve * params.dims + j) % dim for j in range(params.dims)]], shifts[curve]


def lengthened(vectors: pd.Series, longest: float) -> np.ndarray:
    """Vectors as rows, divided by the longest's length, with a further component that makes each one long."""
    x = np.array(list(vectors)) / np.sqrt(longest)
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)


#: Quantiles that a projection is cut by.
KNOTS = 256


def quantiles(index: DataFrame, longest: float, params: HilbertParams) -> dict[int, list[np.ndarray]]:
    """By the vectors' dimension, of each curve's projections KNOTS + 1 quantiles over all rows, near enough: cells
    hold about equally many rows whatever the lengths, so that a few long vectors don't squeeze the others.
    The driver gets as many numbers for each dimension that vectors have."""

    def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["vec"].map(len)):
                axes = np.concatenate([_frame(c, dim + 1, params)[0] for c in range(params.curves)], axis=1)
                yield pd.DataFrame({"dim": dim, "at": list(lengthened(part["vec"], longest) @ axes)})

    rows = index.select("vec").mapInPandas(projected, "dim int, at array<double>")
    ranks = F.array(*[F.lit(k / KNOTS) for k in range(KNOTS + 1)])
    of = [F.percentile_approx(F.col("at")[k], ranks, F.lit(4 * KNOTS)).alias(f"a{k}") for k in range(params.curves * params.dims)]
    return {r["dim"]: [np.array(x) for x in r[1:]] for r in rows.groupBy("dim").agg(*of).collect()}


def nearest(embeddings: DataFrame, every: int = 20, top: int = 20, params: HilbertParams = HilbertParams(), key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Of each row whose id is divisible by `every`: query_id, rank, vec_id, score of the `top` rows of
    largest inner product that are found, ties to the smaller id.

    Vectors that are null, empty, zero or hold nulls or non-finite numbers take no part, nor do rows
    without an id.  Vectors are compared with those of as many dimensions.  Rows with the query's id are
    its own; equal rows count once.  Vectors of different lengths are brought to one by a further
    component, so that the nearest by angle are those of the largest inner product."""
    rows = embeddings.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & valid(F.col("vec")) & F.exists("vec", lambda x: x != 0))
    rows = written(rows, "vectors")
    is_query, keep = F.pmod("id", F.lit(every)) == 0, top + 1
    queries = written(query_vectors(rows, is_query), "queries")
    index = written(distinct_vectors(rows, keep).join(queries, "vec", "left"), "index")
    n = index.count()
    longest = index.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 1.0
    blocks = max(1, -(-n // params.block))
    reach = max(0, -(-int(np.ceil(params.window * blocks)) // 2))
    knots = quantiles(index, longest, params)

    def keyed_on(curve: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dim, part in batch.groupby(batch["vec"].map(len)):
                    axes, shift = _frame(curve, dim + 1, params)
                    at = lengthened(part["vec"], longest) @ axes
                    ranks = np.linspace(0, 1, KNOTS + 1)
                    place = np.stack([np.interp(at[:, j], knots[dim][curve * params.dims + j], ranks) for j in range(params.dims)], axis=1)
                    cells = ((place + shift) / 2 * ((1 << params.bits) - 1)).astype(np.int64)
                    yield part.assign(dim=dim, place=hilbert_keys(cells, params.bits))[["dim", "place", "vec", "ids", "qkey"]]

        return keyed

    shape = "dim int, place long, vec array<double>, ids array<long>, qkey long"
    index = index.withColumn("qkey", F.coalesce("qkey", F.lit(-(1 << 62))))

    def blocked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId()
        for part in slots(batches, params.block):
            asks = part[part["qkey"] != -(1 << 62)]
            yield pd.DataFrame([packed(part) | {"at": at, "qkeys": asks["qkey"].to_numpy("<i8").tobytes(), "qvectors": np.array(list(asks["vec"]), dtype="<f8").tobytes()}])

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                vectors, starts, ids = unpacked(r.vectors, r.starts, r.ids, r.dim)
                counts = np.diff(starts)
                qkeys, asks = np.frombuffer(r.qkeys, dtype="<i8"), np.frombuffer(r.qvectors, dtype="<f8").reshape(-1, r.dim)
                best = Best(len(qkeys), keep)
                best.add(np.arange(len(qkeys)), np.repeat(inner(asks, vectors), counts, axis=1), ids)
                yield best.rows(qkeys)

    found = None
    for curve in range(params.curves):
        dealt = index.mapInPandas(keyed_on(curve), shape).repartitionByRange(blocks, "place", "ids").sortWithinPartitions("place", "ids")
        curve_blocks = written(dealt.mapInPandas(blocked, "at int, qkeys binary, qvectors binary, " + PACKED), f"curve-{curve}")
        last = curve_blocks.agg(F.max("at")).first()[0]
        if last is None:
            continue
        width = min(last, max(2 * reach, int(np.ceil(params.window * (last + 1)))))  # partitions beside its own
        first = F.greatest(F.lit(0), F.least(F.col("at") - F.lit(width // 2), F.lit(last - width)))
        asks = curve_blocks.where(F.length("qkeys") > 0).select("dim", "qkeys", "qvectors", F.explode(F.sequence(first, first + F.lit(width))).alias("at"))
        got = asks.join(curve_blocks.drop("qkeys", "qvectors"), ["at", "dim"]).mapInPandas(compared, FOUND)
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = embeddings.sparkSession.createDataFrame([], FOUND)
    return ranked(merged(found, keep), rows, is_query, queries, top)


PACKED = "n int, dim int, vectors binary, starts binary, ids binary"


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last: a row's score
    doesn't depend on the rows that it is computed with, as it may with a matrix product."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += a[:, k, None] * b[None, :, k]
    return out


def op9_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
