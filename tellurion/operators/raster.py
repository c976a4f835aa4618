"""Rasters in long form (y, x, value): grids, scaling, stencils, terrain, masks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import clamped


def stride(block: int, overlap: float) -> int:
    step = int(block * (1 - overlap))
    if step < 1:
        raise ValueError(f"blocks of {block} with an overlap of {overlap} don't advance")
    return step


def cell(c: str, block: int, overlap: float) -> Column:
    return F.floor((F.col(c) - block / 2) / stride(block, overlap)).cast("int")


def gridded(points: DataFrame, shape: tuple[int, int], block: int, overlap: float) -> DataFrame:
    """Points with their grid cell gy, gx; those outside the grid are left out."""
    step = stride(block, overlap)
    h, w = (shape[0] - block) // step + 1, (shape[1] - block) // step + 1
    g = points.withColumns({"gy": cell("y", block, overlap), "gx": cell("x", block, overlap)})
    return g.where((F.col("gy") >= 0) & (F.col("gy") < h) & (F.col("gx") >= 0) & (F.col("gx") < w))


def filled(grid: DataFrame, shape: tuple[int, int], block: int, overlap: float, value: float = 0.0) -> DataFrame:
    """Every cell of the grid, `value` where it has nothing."""
    step = stride(block, overlap)
    spark = grid.sparkSession
    all_cells = spark.range((shape[0] - block) // step + 1).select(F.col("id").cast("int").alias("gy")).withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit((shape[1] - block) // step))))
    rest = [c for c in grid.columns if c not in ("gy", "gx")]
    return all_cells.join(grid, ["gy", "gx"], "left").select("gy", "gx", *[F.coalesce(c, F.lit(value)).alias(c) for c in rest])


def magnitude_sum(points: DataFrame, shape: tuple[int, int], block: int, overlap: float) -> DataFrame:
    return filled(gridded(points, shape, block, overlap).groupBy("gy", "gx").agg(F.sum("mag").alias("mag")), shape, block, overlap)


def velocity_grids(points: DataFrame, shape: tuple[int, int], block: int, overlap: float) -> DataFrame:
    """u, v, mag, ang_deg of each cell, of its last point in ord's order; 0 without one."""
    g = gridded(points, shape, block, overlap).groupBy("gy", "gx").agg(F.max_by(F.struct("u", "v"), "ord").alias("l")).select("gy", "gx", "l.*")
    g = g.withColumns({"mag": F.hypot("u", "v"), "ang_deg": F.pmod(F.degrees(F.atan2("v", "u")), F.lit(360.0))})
    return filled(g, shape, block, overlap)


def scaled_8bit(stack: DataFrame) -> DataFrame:
    """Each scene's values stretched to 0..255, whole; null counts as 0, a flat scene becomes null."""
    w = Window.partitionBy("scene")
    v = F.coalesce("v", F.lit(0.0))
    lo, hi = F.min(v).over(w), F.max(v).over(w)
    return stack.withColumn("v", F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * 255))


def zero_mask(stack: DataFrame) -> DataFrame:
    """y, x, invalid: pixels that are 0 in some scene."""
    return stack.groupBy("y", "x").agg(F.bool_or(F.coalesce(F.col("v") == 0, F.lit(False))).alias("invalid"))


def standardised(stack: DataFrame) -> DataFrame:
    """Each scene to 0..1, then to mean 0 and population deviation 1."""
    w = Window.partitionBy("scene")
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    unit = stack.withColumn("v", (F.col("v") - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return unit.withColumn("v", (F.col("v") - F.avg("v").over(w)) / F.nullif(F.stddev_pop("v").over(w), F.lit(0.0)))


def stretched(stack: DataFrame) -> DataFrame:
    """Scaled to a maximum of 255, absolute, rounded, at most 255: what dense flow works on."""
    top = F.max("v").over(Window.partitionBy("scene"))
    return stack.withColumn("v", F.least(F.lit(255.0), F.round(F.abs(F.col("v") * 255 / F.nullif(top, F.lit(0.0))))))


def masked(stack: DataFrame, mask: DataFrame) -> DataFrame:
    """The stack with null for every pixel that the mask (y, x, invalid) rules out."""
    out = stack.join(mask.where("invalid").select("y", "x", F.lit(True).alias("_out")), ["y", "x"], "left")
    return out.withColumn("v", F.when(F.col("_out").isNull(), F.col("v"))).drop("_out")


def preprocessed(stack: DataFrame, method: str | None, height: int, width: int, custom: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """What a method works on: orientation, stretched and standardised, for cross_corr; 8 bit for optical_flow;
    the values for None.  Nulls count as 0.  `custom` is a function of a scene's image, applied last, a task a
    scene."""
    stack = stack.withColumn("v", F.coalesce("v", F.lit(0.0)))
    if method == "cross_corr":
        stack = standardised(orientation(stack, height, width))
    elif method == "optical_flow":
        stack = stretched(stack)
    elif method is not None:
        raise ValueError(f"no such method: {method}")
    if custom is None:
        return stack

    def applied(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width))
        image[pdf["y"], pdf["x"]] = pdf["v"]
        return pdf[["scene", "y", "x"]].assign(v=np.asarray(custom(image), dtype=float)[pdf["y"], pdf["x"]])

    kind = dict(stack.dtypes)["scene"]
    return stack.select("scene", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v").groupBy("scene").applyInPandas(applied, f"scene {kind}, y int, x int, v double")


def orientation(stack: DataFrame, height: int, width: int, whole: bool = False) -> DataFrame:
    """v as cosine plus sine of the angles of the four directions' ridges (twice a pixel less its neighbours),
    straight and diagonal; mirrored edges (the edge not repeated).  `whole`: for stacks of 8 bits, whose ridges
    are kept within 8 bits too, so that valleys are 0."""
    def at(j: Column, n: int) -> Column:
        m = F.pmod(j, F.lit(2 * (n - 1)))
        return F.when(m < n, m).otherwise(2 * (n - 1) - m)

    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    spread = stack.select("scene", "y", "x", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), at(F.col("y") + dy, height).alias("sy"), at(F.col("x") + dx, width).alias("sx")) for k, (dy, dx) in enumerate(steps)])).alias("e")).select("scene", "y", "x", "e.*")
    source = stack.select("scene", F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    n = spread.join(source, ["scene", "sy", "sx"]).groupBy("scene", "y", "x").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"p{k}") for k in range(9)])
    ridge = lambda a, b: 2 * F.col("p4") - F.col(f"p{a}") - F.col(f"p{b}")
    kept = lambda a, b: F.least(F.greatest(ridge(a, b), F.lit(0.0)), F.lit(255.0)) if whole else ridge(a, b)
    straight, diagonal = F.atan2(kept(3, 5), kept(1, 7)), F.atan2(kept(0, 8), kept(2, 6))
    return n.select("scene", "y", "x", (F.cos(straight) + F.cos(diagonal) + F.sin(straight) + F.sin(diagonal)).alias("v"))


def gradients(dx: float, dy: float) -> tuple[Column, Column]:
    """Of dem along x and y: central differences, one-sided at edges."""
    def gradient(w: Window, step: float) -> Column:
        before, after = F.lag("dem").over(w), F.lead("dem").over(w)
        return F.coalesce((after - before) / (2 * step), (after - F.col("dem")) / step, (F.col("dem") - before) / step, F.lit(0.0))

    return gradient(Window.partitionBy("y").orderBy("x"), dx), gradient(Window.partitionBy("x").orderBy("y"), dy)


def slope(terrain: DataFrame, dx: float = 10.0, dy: float = 10.0) -> DataFrame:
    """Slope in degrees."""
    return terrain.withColumn("slope_deg", F.degrees(F.atan(F.hypot(*gradients(dx, dy)))))


def aspect(terrain: DataFrame, dx: float = 10.0, dy: float = 10.0) -> DataFrame:
    """The direction downhill in degrees clockwise from north; y grows to the south.  0 where it is flat."""
    gx, gy = gradients(dx, dy)
    return terrain.withColumn("aspect_deg", F.pmod(F.degrees(F.atan2(-gx, gy)), F.lit(360.0)))


def shape_of(raster: DataFrame) -> tuple[int, int]:
    """Height and width of a raster, from all of it."""
    found = raster.agg(F.max("y"), F.max("x")).first()
    return (found[0] or 0) + 1, (found[1] or 0) + 1


def resampled_terrain(terrain: DataFrame, shape: tuple[int, int], out: tuple[int, int], columns: tuple[str, ...] = ("dem", "slope", "aspect")) -> DataFrame:
    """y, x and each of `columns`, bilinear, for a terrain to lie on an image of out = (rows, columns): corners
    on corners."""
    spark = terrain.sparkSession
    px = spark.range(out[0]).select(F.col("id").cast("int").alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(out[1] - 1))))
    place = lambda c, n, m: F.col(c) * ((n - 1) / max(1, m - 1))
    px = px.withColumns({"fy": place("y", shape[0], out[0]), "fx": place("x", shape[1], out[1])})
    px = px.withColumns({"y0": F.floor("fy").cast("int"), "x0": F.floor("fx").cast("int")})
    corner = [F.struct(clamped(F.col("y0") + i, F.lit(shape[0])).alias("sy"), clamped(F.col("x0") + j, F.lit(shape[1])).alias("sx"), ((1 - F.abs(F.col("fy") - F.col("y0") - i)) * (1 - F.abs(F.col("fx") - F.col("x0") - j))).alias("w")) for i in (0, 1) for j in (0, 1)]
    four = px.select("y", "x", F.explode(F.array(*corner)).alias("c")).select("y", "x", "c.*")
    source = terrain.select(F.col("y").alias("sy"), F.col("x").alias("sx"), *columns)
    # Spark takes an exploded table to be as small as it was before, and would send all pixels to the driver.
    return four.join(source.hint("merge"), ["sy", "sx"]).groupBy("y", "x").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns])


def bilinear(raster: DataFrame, value: str, shape: tuple[int, int], out: tuple[int, int]) -> DataFrame:
    """`value` resampled to out = (rows, columns), corners on corners."""
    return resampled_terrain(raster, shape, out, (value,))


def upsampled(grid: DataFrame, value: str, shape: tuple[int, int], out: tuple[int, int]) -> DataFrame:
    """`value` of the nearest grid cell for every pixel of out = (rows, columns)."""
    spark = grid.sparkSession
    px = spark.range(out[0]).select(F.col("id").cast("int").alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(out[1] - 1))))
    near = lambda c, n, m: F.least(F.floor((F.col(c) + 0.5) * n / m), F.lit(n - 1)).cast("int")
    return px.withColumns({"gy": near("y", shape[0], out[0]), "gx": near("x", shape[1], out[1])}).join(grid.select("gy", "gx", value), ["gy", "gx"]).select("y", "x", value)


def neighbours(mask: DataFrame) -> DataFrame:
    """gy, gx, on, ons (set cells of the 3 by 3 around, outside none), cells (how many of the 9 exist)."""
    around = mask.select("on", F.explode(F.array(*[F.struct((F.col("gy") + i).alias("gy"), (F.col("gx") + j).alias("gx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("p")).select("on", "p.*")
    sums = around.groupBy("gy", "gx").agg(F.sum(F.col("on").cast("int")).alias("ons"), F.count("*").alias("cells"))
    return mask.join(sums, ["gy", "gx"])


def dilated(mask: DataFrame, cross: bool = False) -> DataFrame:
    """On where one of the 3 by 3 around is, or with `cross` one of the four sides or itself."""
    if not cross:
        return neighbours(mask).select("gy", "gx", (F.col("ons") > 0).alias("on"))
    steps = F.array(*[F.struct((F.col("gy") + i).alias("gy"), (F.col("gx") + j).alias("gx")) for i, j in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))])
    reach = mask.where("on").select(F.explode(steps).alias("p")).select("p.*").distinct().withColumn("_on", F.lit(True))
    return mask.join(reach, ["gy", "gx"], "left").select("gy", "gx", F.coalesce("_on", F.lit(False)).alias("on"))


def _thinned_once(mask: DataFrame, second: bool) -> DataFrame:
    """One of the two halves of a thinning step.  A cell goes if the cells around it are one run, of which two
    or three count once paired with their neighbours either way, and the half's own sides are free."""
    around = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]  # from the right, anticlockwise
    steps = F.array(*[F.struct((F.col("gy") - i).alias("gy"), (F.col("gx") - j).alias("gx"), F.lit(k).alias("k")) for k, (i, j) in enumerate(around)])
    ons = mask.where("on").select(F.explode(steps).alias("p")).select("p.*").groupBy("gy", "gx")
    ons = ons.agg(*[F.coalesce(F.bool_or(F.col("k") == k), F.lit(False)).alias(f"_x{k}") for k in range(8)])
    m = mask.join(ons, ["gy", "gx"], "left")
    x = [F.coalesce(f"_x{k % 8}", F.lit(False)) for k in range(9)]
    one = lambda c: c.cast("int")
    runs = sum((one(~x[2 * k] & (x[2 * k + 1] | x[(2 * k + 2) % 8])) for k in range(4)), F.lit(0))
    before, after = (sum((one(x[2 * k + a] | x[(2 * k + b) % 8]) for k in range(4)), F.lit(0)) for a, b in ((0, 1), (1, 2)))
    free = ~((x[5] | x[6] | ~x[3]) & x[4]) if second else ~((x[1] | x[2] | ~x[7]) & x[0])
    goes = (runs == 1) & F.least(before, after).between(2, 3) & free
    return m.select("gy", "gx", (F.col("on") & ~goes).alias("on"))


def thinned(mask: DataFrame) -> DataFrame:
    """One step of thinning: cells of the outline go as long as nothing comes apart."""
    return _thinned_once(_thinned_once(mask, False), True)


def processed_mask(mask: DataFrame) -> DataFrame:
    """A mask's clean-up: closed and thickened, twice, the majority, holes filled, thinned once."""
    for _ in range(2):
        mask = dilated(closed(mask), cross=True)
    return thinned(without_holes(majority(mask)))


def eroded(mask: DataFrame) -> DataFrame:
    return neighbours(mask).select("gy", "gx", (F.col("ons") == F.col("cells")).alias("on"))


def closed(mask: DataFrame) -> DataFrame:
    return eroded(dilated(mask))


def majority(mask: DataFrame, least: int = 5) -> DataFrame:
    return neighbours(mask).select("gy", "gx", (F.col("ons") >= least).alias("on"))


def without_holes(mask: DataFrame) -> DataFrame:
    """The mask with every hole on: cells that are off and not linked, side by side, to the border.  One task
    holds the mask, a bit for each cell of its grid; a region of 100,000 km^2 at steps of 30 m has 10^8."""
    def flooded(pdf: pd.DataFrame) -> pd.DataFrame:
        gy, gx = pdf["gy"].to_numpy() - pdf["gy"].min(), pdf["gx"].to_numpy() - pdf["gx"].min()
        off = np.zeros((gy.max() + 3, gx.max() + 3), dtype=bool)
        off[gy + 1, gx + 1] = ~pdf["on"].fillna(False).to_numpy(dtype=bool)
        off[0], off[-1], off[:, 0], off[:, -1] = True, True, True, True
        seen, fresh = np.zeros_like(off), np.zeros_like(off)
        fresh[0, 0] = True
        while fresh.any():
            seen |= fresh
            near = np.zeros_like(fresh)
            near[1:] |= fresh[:-1]
            near[:-1] |= fresh[1:]
            near[:, 1:] |= fresh[:, :-1]
            near[:, :-1] |= fresh[:, 1:]
            fresh = near & off & ~seen
        return pdf[["gy", "gx"]].assign(on=~seen[gy + 1, gx + 1])

    return mask.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(flooded, "gy int, gx int, on boolean")


def cropped(raster: DataFrame, mask: DataFrame, value: str) -> DataFrame:
    """The raster's value where the mask is on, else null."""
    return raster.join(mask, ["gy", "gx"], "left").withColumn(value, F.when(F.col("on"), F.col(value))).drop("on")


