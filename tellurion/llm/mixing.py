"""Mixing sources to target weights by entropy balancing.

Every document i gets a rate r_i, the nearest to 1 in relative entropy (each word counting alike) under these
constraints on words: each source's rates meet its target; each band of sizes (1, 2-3, 4-7, ... words) keeps its
share of all words as nearly as the sources allow, a miss costing its square; no rate exceeds 3.  The solution
is r_i = min(3, exp(lambda of its source + mu of its band)), where lambda and mu minimise the convex dual

    sum_sb W_sb phi(lambda_s + mu_b) - sum_s T_s lambda_s - sum_b B_b mu_b + rho / 2 sum_b mu_b^2

with phi' = min(3, exp).  Newton steps with a line search: Spark sums the gradient and the Hessian over all
sources, of which the lambdas are eliminated (its block for them is diagonal); the driver solves for the bands
alone, a system of a fixed size; the lambdas stay in a table, a row for each source.

The rates are then rounded into whole copies: a document gets its rate's whole part, and documents in an order
fixed by a hash get one copy more until their band's words suffice, then others of the source until its words
do; what is still missing comes from the one document left whose size is nearest to it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Sub-groups that each source's documents are dealt to, so that no task sorts a whole source.
SLICES = 1024
#: Bands of sizes: powers of two, the last for all beyond.
BANDS = 20
LIMIT = 3.0
#: What a band's miss costs, as a part of all words.
RHO = 0.05
NEWTON_STEPS = 50


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str = "source", limit: float = LIMIT) -> DataFrame:
    """One row for each source: source, source_size, target.  `sizes` has words as `size`, in rows for documents
    or for parts of a source.

    Sources weigh 1, 2, 3, repeating, in the order of their names' bytes, null last.  They share all
    words; a target stops at `limit` times the source's size and the excess goes to the others by weight.
    So target = min(limit * size, level * weight), where the level follows from the sources in the order in
    which they reach their limit.  Numbering the sources takes one task: a narrow row a source, not a document."""
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", ((order - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(limit))
    whole = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    per = per.withColumn("total", F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The level were all sources before this one at their limit and none after it.
    per = per.withColumn("level", left / rest)
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    per = per.withColumn("level", F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"])
    return per.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _array(numbers: np.ndarray) -> Column:
    return F.array(*[F.lit(float(x)) for x in numbers])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _rates(shift: Column, mu: Column) -> Column:
    return F.transform(mu, lambda m: F.least(F.lit(LIMIT), F.exp(F.least(shift + m, F.lit(50.0)))))


def balanced(per: DataFrame) -> DataFrame:
    """`per`: a row for each source with its target and `words`, an array of its words by band.  Adds `rates`,
    an array by band: the solution of the dual.  Sources whose target is 3 times their words have that rate,
    those without words or target rate 0; neither takes part in the steps."""
    total = _sum(F.col("words"))
    free = (F.col("target") > 0) & (F.col("target") < total * (LIMIT * (1 - 1e-9)))
    per = written(per.withColumn("free", free).withColumn("lam", F.when(free, F.ln(F.col("target") / total)).otherwise(0.0)), "mix-sources")
    # The bands' shares of the words that the free sources are to have.
    sums = per.where("free").agg(F.coalesce(F.sum("target"), F.lit(0.0)), *[F.coalesce(F.sum(F.col("words")[b]), F.lit(0.0)) for b in range(BANDS)]).first()
    held = np.array(sums[1:], dtype=float)
    all_words = float(sums[0])
    wanted, rho = all_words * held / max(held.sum(), 1.0), RHO * max(all_words, 1.0)
    mu = np.zeros(BANDS)
    for _ in range(NEWTON_STEPS if held.sum() else 0):
        rates = _rates(F.col("lam"), _array(mu))
        rows = per.where("free").withColumn("w", F.zip_with("words", rates, lambda w, r: w * r))
        rows = rows.withColumn("d", F.zip_with("words", rates, lambda w, r: F.when(r < LIMIT, w * r).otherwise(0.0)))
        # A source all of whose bands are at the limit has no second derivative: a small one leads it back.
        rows = rows.withColumn("g", _sum(F.col("w")) - F.col("target")).withColumn("h", F.greatest(_sum(F.col("d")), 1e-3 * F.col("target")))
        # The gradient's and the Hessian's parts of a source, one behind the other, summed by place.
        outer = F.flatten(F.transform("d", lambda x: F.transform("d", lambda y: x * y / F.col("h"))))
        parts = F.concat(F.array(F.abs(F.col("g"))), "w", "d", F.transform("d", lambda x: x * F.col("g") / F.col("h")), outer)
        sums = rows.select(F.posexplode(parts).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"))
        got = np.array([r["x"] for r in sorted(sums.collect())])
        miss, (w, d, dg), outer = got[0], got[1 : 1 + 3 * BANDS].reshape(3, BANDS), got[1 + 3 * BANDS :].reshape(BANDS, BANDS)
        slope = w - wanted + rho * mu
        if max(miss, np.abs(slope).max()) < 1e-9 * all_words:
            break
        second = np.diag(d + rho) - outer
        step = np.linalg.solve(second, dg - slope)
        move = -(F.col("g") + _sum(F.zip_with("d", _array(step), lambda d, s: d * s))) / F.col("h")
        rows = rows.withColumn("move", F.greatest(F.lit(-5.0), F.least(F.lit(5.0), move)))

        def dual(t: float) -> Column:
            """Sums of the dual over sources, a part `t` of the step on."""
            eta = F.transform(_array(mu + t * step), lambda m: F.col("lam") + F.lit(t) * F.col("move") + m)  # noqa: B023
            top = math.log(LIMIT)
            phi = F.transform(eta, lambda e: F.when(e <= top, F.exp(F.least(e, F.lit(top)))).otherwise(LIMIT * (1 + e - top)))
            return F.sum(_sum(F.zip_with("words", phi, lambda w, p: w * p)) - F.col("target") * (F.col("lam") + F.lit(t) * F.col("move")))

        steps = [2.0**-k for k in range(8)]
        values = rows.agg(*[dual(t).alias(f"t{k}") for k, t in enumerate(steps)], dual(0.0).alias("now")).first()
        value = lambda k, t: values[k] - wanted @ (mu + t * step) + rho / 2 * ((mu + t * step) ** 2).sum()
        found = [value(k, t) for k, t in enumerate(steps)]
        k = int(np.argmin(found))
        if not found[k] < value(len(steps), 0.0) - 1e-13 * all_words:
            break  # no step makes it less: at the minimum to the numbers' precision
        mu = mu + steps[k] * step
        moved = rows.select(F.col("source").alias("_s"), F.col("move").alias("_move"))
        per = per.join(moved, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        per = written(per.withColumn("lam", F.col("lam") + F.lit(steps[k]) * F.coalesce("_move", F.lit(0.0))).drop("_move"), "mix-sources")
    # The sources' own constraints to the last digit, by bisection of each lambda at the bands' mu.
    words_at = lambda lam: _sum(F.zip_with("words", _rates(lam, _array(mu)), lambda w, r: w * r))
    half = lambda a: F.when(words_at((a["lo"] + a["hi"]) / 2) < F.col("target"), F.struct(((a["lo"] + a["hi"]) / 2).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), ((a["lo"] + a["hi"]) / 2).alias("hi")))
    ends = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct((F.col("lam") - 30.0).alias("lo"), (F.col("lam") + 30.0).alias("hi")), lambda a, _: half(a))
    per = per.withColumn("lam", F.when(F.col("free"), ends["hi"]).otherwise(F.col("lam")))
    fixed = F.transform("words", lambda w: F.when(F.col("target") > 0, F.lit(LIMIT)).otherwise(0.0))
    return written(per.withColumn("rates", F.when(F.col("free"), _rates(F.col("lam"), _array(mu))).otherwise(fixed)), "mix-rates")


def _computed(rows: DataFrame) -> DataFrame:
    """`rows` computed once, for narrow rows that are read several times.  Spark keeps them as blocks, not as a
    file for each task, for each of which a local file system starts processes (chmod).  What is lost is
    computed again from the last table written."""
    return rows.persist(StorageLevel.DISK_ONLY)


def _prefix(rows: DataFrame, keys: list[str], quota: str, more: str, left: str) -> DataFrame:
    """Adds `more`: how many of a row's `left` equal documents are taken, so that the first documents in the
    order of the hash within `keys` are, as long as their words come to `quota` at most.  Slices are summed
    first; a task sorts one slice."""
    words = F.col("size") * F.col(left)
    slices = rows.groupBy(*keys, "_slice").agg(F.sum(words).alias("_words"))
    upto = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("_slice").alias("_slice_"), F.coalesce(F.sum("_words").over(upto), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_slice").orderBy("_hash", "_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in [*keys, "_slice"]]
    on = same[0]
    for c in same[1:]:
        on &= c
    room = F.floor((F.col(quota) + 1e-6 - F.col("_start") - F.col("_before")) / F.col("size"))
    taken = F.when((F.col("size") > 0) & (room > 0), F.least(room, F.col(left))).otherwise(0).cast("long")
    return rows.join(slices, on).withColumn(more, taken).drop(*[f"{k}_" for k in [*keys, "_slice"]], "_start", "_before")


def _with_source(rows: DataFrame, per: DataFrame, how: str = "inner", ways: int = 16) -> DataFrame:
    """`rows` with what `per` has of their source (_s).  A source's rows are dealt to `ways` keys, so that one
    which holds a large share of all isn't one task."""
    dealt = rows.withColumn("_way", F.pmod(F.col("_hash"), F.lit(ways)).cast("int"))
    repeated = per.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return dealt.join(repeated, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_way") == F.col("_to")), how).drop("_s", "_way", "_to")


def mixed_rows(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """A row for all rows of `docs` that are equal in source, key, size and the columns of `carry`: these, as
    `_source`, `_key`, `size` and `carry` (a struct); rows (how many), copies (of each), more (how many of them
    get one copy more), source_size and target.

    The same rows give the same result on every run and for any partitioning.  Null and wordless texts have
    size 0 and take nothing.  Null is a source of its own, the last.  No document gets more than 3 copies."""
    packed = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry")] if carry else []
    sizes = docs.select(F.col(f"`{source}`").alias("_source"), F.col(f"`{key}`").alias("_key"), word_count(F.col(f"`{text}`")).alias("size"), *packed)
    sizes = sizes.withColumn("_hash", F.xxhash64("_key", "size", *["carry"] * bool(packed), F.lit(7)))
    # Equal rows are one: a source, key or text that many rows share is counted on the map side.
    rows = sizes.groupBy("_source", "_key", "size", "_hash").agg(F.count("*").alias("rows"), *[F.any_value("carry").alias("carry")] * bool(packed))
    rows = written(rows, "mix-rows")
    band = F.least(F.floor(F.log2(F.greatest("size", F.lit(1)))), F.lit(BANDS - 1)).cast("int")
    thin = rows.drop("carry").withColumn("_band", band).withColumn("_slice", F.pmod(F.shiftright("_hash", 20), F.lit(SLICES)).cast("int"))
    cells = thin.groupBy("_source", "_band").agg(F.sum(F.col("size") * F.col("rows")).alias("size"))
    # A few numbers for each source: as many files as cores, not as partitions.
    cells = written(cells.coalesce(docs.sparkSession.sparkContext.defaultParallelism), "mix-cells")
    words = cells.groupBy(F.col("_source").alias("_s")).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("_band") == b, F.col("size"))), F.lit(0)).cast("double") for b in range(BANDS)]).alias("words"))
    per = source_targets(cells, "_source").join(words, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    per = balanced(per)

    thin = _with_source(thin, per.select(F.col("source").alias("_s"), "source_size", "target", "rates"))
    thin = thin.withColumn("_rate", F.element_at("rates", F.col("_band") + 1)).drop("rates")
    thin = thin.withColumn("copies", F.when(F.col("size") > 0, F.floor(F.col("_rate") + 1e-9)).otherwise(0).cast("long"))
    thin = thin.join(cells.select(F.col("_source").alias("_s"), F.col("_band").alias("_b"), F.col("size").alias("_words")), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_band") == F.col("_b"))).drop("_s", "_b")
    thin = thin.withColumn("_quota", F.greatest((F.col("_rate") - F.col("copies")) * F.col("_words"), F.lit(0.0)))
    thin = written(_prefix(thin, ["_source", "_band"], "_quota", "_first", "rows"), "mix-first")

    def missing(took: Column, name: str) -> DataFrame:
        """What each source still lacks."""
        got = thin.groupBy(F.col("_source").alias("_s")).agg((F.first("target") - F.sum(F.col("size") * took)).alias(name))
        return got.withColumn(name, F.coalesce(name, F.lit(0.0)))

    spare = F.when((F.col("copies") < LIMIT) & (F.col("size") > 0), F.col("rows") - F.col("_first")).otherwise(0)
    thin = _with_source(thin, missing(F.col("copies") * F.col("rows") + F.col("_first"), "_lack")).withColumn("_spare", spare)
    thin = _computed(_prefix(thin, ["_source"], "_lack", "_second", "_spare").drop("_lack"))
    thin = _with_source(thin, missing(F.col("copies") * F.col("rows") + F.col("_first") + F.col("_second"), "_lack"))
    miss = F.abs(F.col("size") - F.col("_lack"))
    last = thin.where((F.col("_spare") > F.col("_second")) & (miss < F.col("_lack"))).groupBy(F.col("_source").alias("_s"))
    last = last.agg(F.min(F.struct(miss.alias("miss"), "_hash", "_key", "size")).alias("_last"))
    thin = _with_source(thin, last, "left")
    is_last = (F.col("_last._hash") == F.col("_hash")) & F.col("_last._key").eqNullSafe(F.col("_key")) & (F.col("_last.size") == F.col("size"))
    more = F.col("_first") + F.col("_second") + F.coalesce(is_last, F.lit(False)).cast("long")
    out = thin.select("_source", "_key", "size", "_hash", "rows", "copies", more.alias("more"), F.col("source_size").cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"))
    if not packed:
        return out
    whole = rows.select(F.col("_hash").alias("_h"), F.col("_key").alias("_k"), F.col("_source").alias("_s"), F.col("size").alias("_z"), "carry")
    same = (F.col("_h") == F.col("_hash")) & F.col("_k").eqNullSafe(F.col("_key")) & F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_z") == F.col("size"))
    return out.join(whole, same).drop("_h", "_k", "_s", "_z")


def mixed_copies(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """A row for every row of `docs`: the columns named in `carry` (default: the key), size, source_size,
    target, copies and taken = copies * size.  Else as `mixed_rows`."""
    rows = mixed_rows(docs, source, text, key, carry)
    kept = [F.col("carry")[c].alias(c) for c in carry] if carry else [F.col("_key").alias(key)]
    parts = F.array(F.struct(F.col("more").alias("n"), (F.col("copies") + 1).alias("copies")), F.struct((F.col("rows") - F.col("more")).alias("n"), F.col("copies")))
    rows = rows.withColumn("_p", F.explode(F.filter(parts, lambda p: p["n"] > 0)))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_p.n"))))
    copies = F.col("_p.copies")
    return rows.select(*kept, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with all their columns, whatever their names."""
    rows = mixed_rows(docs, source, text, key, docs.columns)
    rows = rows.withColumn("_n", F.col("copies") * F.col("rows") + F.col("more")).where("_n > 0")
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("carry.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
