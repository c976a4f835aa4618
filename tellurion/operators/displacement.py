"""Filters over each pair's displacements, in a fixed order, and the velocity field that they leave.

Every filter takes and gives a boolean column `valid`; statistics are those of the rows still valid.  Rows
are dropped once, at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import array_median, clamped, frame, gaussian_weights, in_ranges, reflected


def with_pair(d: DataFrame, **sums: Column) -> DataFrame:
    """Each row with sums over its pair: partial sums and a join, so that no task holds a whole pair."""
    per = d.groupBy("pair_id").agg(*[c.alias(n) for n, c in sums.items()])
    return d.join(per, "pair_id", "left")


def kept(c: str) -> Column:
    return F.when(F.col("valid"), F.col(c))


def begin(d: DataFrame) -> DataFrame:
    return d.withColumn("valid", F.lit(True))


def still(d: DataFrame, condition: Column) -> DataFrame:
    return d.withColumn("valid", F.col("valid") & F.coalesce(condition, F.lit(False)))


def by_magnitude(d: DataFrame, least: float = 0.0, most: float = math.inf) -> DataFrame:
    m = F.hypot("u", "v")
    return still(d, (m > least) & (m < most))


def by_mask(d: DataFrame, mask: DataFrame, height: int, width: int) -> DataFrame:
    """`mask`: y, x, invalid.  Points outside the raster take the nearest pixel."""
    at = d.withColumn("_y", clamped(F.col("y"), F.lit(height))).withColumn("_x", clamped(F.col("x"), F.lit(width)))
    m = mask.select(F.col("y").alias("_y"), F.col("x").alias("_x"), "invalid")
    return still(at.join(m, ["_y", "_x"], "left"), ~F.coalesce("invalid", F.lit(False))).drop("_y", "_x", "invalid")


def by_deviation(d: DataFrame, k: float = 3.0) -> DataFrame:
    d = with_pair(d, **{f"_m{c}": F.avg(kept(c)) for c in ("u", "v")}, **{f"_s{c}": F.stddev_pop(kept(c)) for c in ("u", "v")})
    near = [F.abs(F.col(c) - F.col(f"_m{c}")) < k * F.col(f"_s{c}") for c in ("u", "v")]
    return still(d, near[0] & near[1]).drop("_mu", "_mv", "_su", "_sv")


def around(values: Column, i: Column, n: Column, radius: int) -> Column:
    """The frame's values from i - radius to i + radius of n rows, mirrored at the edges.  The frame
    begins at row max(0, i - radius)."""
    first = F.greatest(i - radius, F.lit(0))
    return F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda k: F.get(values, (reflected(i + k, n) - first).cast("int"))["v"])


def weighted(aligned: Column, name: str, sigma: float) -> Column:
    """The Gaussian mean of a field of the aligned values; nulls weigh nothing."""
    weights = F.array(*map(F.lit, gaussian_weights(sigma)))
    return F.aggregate(F.zip_with(aligned, weights, lambda x, w: w * F.coalesce(x[name], F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def by_angle(d: DataFrame, threshold: float = 30.0, sigma: float = 1.0) -> DataFrame:
    """Direction within `threshold` degrees of that smoothed along the points' order."""
    r = len(gaussian_weights(sigma)) // 2
    length = F.hypot("u", "v")
    unit = [F.when(F.col("valid"), F.coalesce(F.try_divide(F.col(c), length), F.lit(0.0))).alias(n) for c, n in (("u", "c"), ("v", "s"))]
    d = with_pair(d, _n=F.count("*")).withColumn("_v", F.struct(*unit, F.col("valid").cast("double").alias("m")))
    d = in_ranges(d, "pt_idx", r, r)
    d = d.withColumn("_f", frame(F.col("_v"), ["pair_id", "_range"], "pt_idx", r, r)).where("_own")
    d = d.withColumn("_a", around(F.col("_f"), F.col("pt_idx"), F.col("_n"), r))
    norm = F.greatest(weighted(F.col("_a"), "m", sigma), F.lit(1e-6))
    d = d.withColumn("_off", F.atan2("v", "u") - F.atan2(weighted(F.col("_a"), "s", sigma) / norm, weighted(F.col("_a"), "c", sigma) / norm))
    return still(d, F.degrees(F.abs(F.atan2(F.sin("_off"), F.cos("_off")))) <= threshold).drop("_v", "_n", "_f", "_a", "_off", "_range", "_own")


def without_median(d: DataFrame, **more: Column) -> DataFrame:
    """The valid rows' median taken from all rows; with `more` sums over each pair as columns."""
    d = with_pair(d, _mu=F.median(kept("u")), _mv=F.median(kept("v")), **more)
    return d.withColumns({c: F.col(c) - F.col(f"_m{c}") for c in ("u", "v")}).drop("_mu", "_mv")


def running_median(d: DataFrame, size: int) -> DataFrame:
    """mu, mv: medians of the valid values around each point in order, the edge repeated; a window of even
    size reaches one further back."""
    back, ahead = size // 2, size - 1 - size // 2
    d = in_ranges(with_pair(d, _n=F.count("*")), "pt_idx", back, ahead)
    d = d.withColumns({f"_f{c}": frame(kept(c), ["pair_id", "_range"], "pt_idx", back, ahead) for c in ("u", "v")}).where("_own")
    first = F.greatest(F.col("pt_idx") - back, F.lit(0))
    at = lambda c: F.transform(F.sequence(F.lit(-back), F.lit(ahead)), lambda k: F.get(F.col(f"_f{c}"), (clamped(F.col("pt_idx") + k, F.col("_n")) - first).cast("int"))["v"])
    return d.withColumns({f"m{c}": array_median(at(c)) for c in ("u", "v")}).drop("_n", "_fu", "_fv", "_range", "_own")


def by_neighbours(d: DataFrame, threshold: float, size: int = 5) -> DataFrame:
    d = running_median(d, size)
    return still(d, F.abs(F.hypot("u", "v") - F.hypot("mu", "mv")) < threshold).drop("mu", "mv")


def median_smoothed(d: DataFrame, size: int = 5) -> DataFrame:
    d = running_median(d, size)
    return d.withColumns({c: F.when(F.col("valid"), F.col(f"m{c}")).otherwise(F.col(c)) for c in ("u", "v")}).drop("mu", "mv")


def by_quality(d: DataFrame, name: str, threshold: float) -> DataFrame:
    """pkr or snr at least `threshold`; no filter in a pair that has none at all."""
    some = f"_some_{name}"
    if some not in d.columns:
        d = with_pair(d, **{some: F.count(name)})
    return still(d, (F.col(some) == 0) | (F.col(name) >= threshold)).drop(some)


def end(d: DataFrame) -> DataFrame:
    return d.where("valid").drop("valid")


def filter_pairs(d: DataFrame, *, least: float = 0.0, most: float = math.inf, deviation: float | None = None, angle: float | None = None, subtract: bool = True, erratic: float | None = None, smooth: int | None = None, pkr: float | None = 1.3, snr: float | None = 3.0) -> DataFrame:
    """All filters in their order, those that are asked for."""
    d = by_magnitude(begin(d), least, most)
    if deviation is not None:
        d = by_deviation(d, deviation)
    if angle is not None:
        d = by_angle(d, angle)
    counts = {f"_some_{name}": F.count(name) for name, t in (("pkr", pkr), ("snr", snr)) if t is not None}
    if subtract:
        d = without_median(d, **counts)
    if erratic is not None:
        d = by_neighbours(d, erratic)
    if smooth is not None:
        d = median_smoothed(d, smooth)
    for name, t in (("pkr", pkr), ("snr", snr)):
        if t is not None:
            d = by_quality(d, name, t)
    return end(d)


def median_field(d: DataFrame, years: DataFrame | None, pixel_size: float = 10.0, slope: DataFrame | None = None) -> DataFrame:
    """x, y, ord, u, v, mag, ang: medians over pairs, by year if `years` (pair_id, years) is given, in
    metres; with `slope` (y, x, slope in degrees) along the slope, points without one left out.  ord keeps
    the points in the order in which pairs first have them."""
    t = F.lit(1.0)
    if years is not None:
        d, t = d.join(years, "pair_id"), F.col("years")
    f = d.groupBy("x", "y").agg((F.median(F.try_divide(F.col("u"), t)) * pixel_size).alias("u"), (F.median(F.try_divide(F.col("v"), t)) * pixel_size).alias("v"), F.min(F.struct("pair_id", "pt_idx")).alias("ord"))
    if slope is not None:
        s = slope.select(F.col("y").alias("_y"), F.col("x").alias("_x"), F.greatest(F.cos(F.radians("slope")), F.lit(1e-3)).alias("_k"))
        f = f.join(s, (F.col("x").cast("int") == F.col("_x")) & (F.col("y").cast("int") == F.col("_y")))
        f = f.withColumns({c: F.col(c) / F.col("_k") for c in ("u", "v")}).drop("_x", "_y", "_k")
    return f.withColumns({"mag": F.hypot("u", "v"), "ang": F.atan2("v", "u")})
