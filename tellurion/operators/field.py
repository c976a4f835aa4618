"""Filters over the velocity field of all points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import RANGE, frame, gaussian_weights, in_ranges, turned
from .displacement import around, weighted


def above(field: DataFrame, threshold: float | None = None, share: float = 0.95) -> DataFrame:
    """Magnitude above the threshold, or above the percentile of all (interpolated)."""
    if threshold is not None:
        return field.where(F.col("mag") > threshold)
    limit = field.agg(F.percentile("mag", share).alias("limit"))  # one number
    return field.join(F.broadcast(limit), F.col("mag") > F.col("limit")).drop("limit")


def numbered(field: DataFrame) -> DataFrame:
    """Each point with _i, its place in the order of ord (pair_id, pt_idx), and _n, how many there are.  Slices
    of a pair's points are counted first; what is ordered as a whole has a row for each slice."""
    f = field.withColumns({"_p": F.col("ord.pair_id"), "_k": F.floor(F.col("ord.pt_idx") / RANGE)})
    slices = f.groupBy("_p", "_k").agg(F.count("*").alias("_c"))
    slices = slices.withColumns({"_before": F.sum("_c").over(Window.orderBy("_p", "_k")) - F.col("_c"), "_n": F.sum("_c").over(Window.partitionBy())}).drop("_c")
    here = F.row_number().over(Window.partitionBy("_p", "_k").orderBy("ord"))
    return f.join(slices, ["_p", "_k"]).withColumn("_i", F.col("_before") + here - 1).drop("_p", "_k", "_before")


def coherent(field: DataFrame, threshold: float = 30.0, sigma: float = 1.0) -> DataFrame:
    """Direction within `threshold` degrees of that smoothed along ord."""
    r = len(gaussian_weights(sigma)) // 2
    f = in_ranges(numbered(field), "_i", r, r)
    f = f.withColumn("_f", frame(F.struct(F.cos("ang").alias("c"), F.sin("ang").alias("s")), ["_range"], "_i", r, r)).where("_own")
    f = f.withColumn("_a", around(F.col("_f"), F.col("_i"), F.col("_n"), r))
    f = f.withColumn("_off", F.col("ang") - F.atan2(weighted(F.col("_a"), "s", sigma), weighted(F.col("_a"), "c", sigma)))
    return f.where(F.degrees(F.abs(F.atan2(F.sin("_off"), F.cos("_off")))) <= threshold).drop("_i", "_n", "_f", "_a", "_off", "_range", "_own")


def at_pixels(field: DataFrame, terrain: DataFrame, *columns: str) -> DataFrame:
    """Each point with what the terrain has at its pixel (halves to even); points outside are left out."""
    t = terrain.select(F.col("y").alias("_y"), F.col("x").alias("_x"), *columns)
    return field.join(t, (F.bround(F.col("x").cast("double")).cast("int") == F.col("_x")) & (F.bround(F.col("y").cast("double")).cast("int") == F.col("_y"))).drop("_x", "_y")


def steep(field: DataFrame, terrain: DataFrame, least: float = 5.0) -> DataFrame:
    return at_pixels(field, terrain, "slope").where(F.col("slope") >= least).drop("slope")


def downhill(field: DataFrame, terrain: DataFrame, tolerance: float = 45.0) -> DataFrame:
    """Moving within `tolerance` degrees of the slope's direction; y grows downwards."""
    facing = F.pmod(-F.col("aspect") - 270, F.lit(360.0))
    moving = F.pmod(F.degrees(F.atan2(-F.col("v"), F.col("u"))), F.lit(360.0))
    return at_pixels(field, terrain, "aspect").where(turned(facing - moving) <= tolerance).drop("aspect")


def dense(field: DataFrame, eps: float = 10.0, least: int = 5) -> DataFrame:
    """Points that a density clustering would give a cluster: those with `least` points within `eps`,
    themselves among them, and those within eps of such a point.  An equi-join over cells of size eps; each
    point looks at the 9 cells around it."""
    cell = lambda c: F.floor(F.col(c) / eps)
    near = F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])

    def close(a: DataFrame, b: DataFrame) -> DataFrame:
        a = a.select("x", "y", F.explode(near).alias("c")).select("x", "y", "c.*")
        b = b.select(F.col("x").alias("ox"), F.col("y").alias("oy"), cell("x").alias("cx"), cell("y").alias("cy"))
        d2 = (F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2
        return a.join(b, ["cx", "cy"]).where(d2 <= eps * eps)

    points = field.select("x", "y")
    core = close(points, points).groupBy("x", "y").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("x", "y")
    return field.join(close(points, core).select("x", "y").distinct(), ["x", "y"], "left_semi")


def final_map(field: DataFrame, terrain: DataFrame, *, threshold: float | None = None, angle: float | None = 30.0, least_slope: float | None = 5.0, tolerance: float | None = 45.0, eps: float | None = 10.0, least: int = 5, stop_early: bool = False) -> DataFrame:
    """All filters in their order, those that are asked for.  With `stop_early` the rest is left out once a step
    leaves one point or none, which takes a job after each step; else all is one lazy plan."""
    f = above(field, threshold)
    steps = [
        None if angle is None else lambda f: coherent(f, angle),
        None if least_slope is None else lambda f: steep(f, terrain, least_slope),
        None if tolerance is None else lambda f: downhill(f, terrain, tolerance),
        None if eps is None else lambda f: dense(f, eps, least),
    ]
    for step in steps:
        if step is not None:
            if stop_early and len(f.select("x").take(2)) < 2:
                return f
            f = step(f)
    return f


def within(a: DataFrame, b: DataFrame) -> DataFrame:
    """The points that both have."""
    return a.select("x", "y").intersect(b.select("x", "y"))
