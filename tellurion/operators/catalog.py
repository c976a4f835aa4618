"""Selecting scenes from a catalog: scan, coverage, cloud and snow, dates, seasons, samples, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(scenes: DataFrame, roi: tuple[float, float, float, float], cloud_max: float = 10, buffer: float = 1.0) -> DataFrame:
    """Scenes that touch the buffered region, with less cloud than `cloud_max`."""
    x0, y0, x1, y1 = roi
    touch = (F.col("xmin") <= x1 + buffer) & (F.col("xmax") >= x0 - buffer) & (F.col("ymin") <= y1 + buffer) & (F.col("ymax") >= y0 - buffer)
    return scenes.where(touch & (F.col("cloud") < cloud_max))


def covering(scenes: DataFrame, roi: tuple[float, float, float, float]) -> DataFrame:
    """Scenes whose footprint holds the whole region."""
    x0, y0, x1, y1 = roi
    return scenes.where((F.col("xmin") <= x0) & (F.col("xmax") >= x1) & (F.col("ymin") <= y0) & (F.col("ymax") >= y1))


def clean_id(image_id: Column) -> Column:
    """The id from its date and time on."""
    return F.regexp_replace(image_id, r"^.*?(\d{8}T\d{6}.*)$", "$1")


def index(a: Column, b: Column) -> Column:
    """A normalised difference; null where the sum is 0."""
    return F.try_divide(a - b, a + b)


def flagged_share(pixels: DataFrame, flag: Column, name: str) -> DataFrame:
    """Percent of a scene's pixels that are flagged; a scene without data counts as 0."""
    return pixels.groupBy("image_id").agg((100 * F.coalesce(F.sum(flag.cast("int")), F.lit(0)) / F.coalesce(F.nullif(F.count(flag), F.lit(0)), F.lit(1))).alias(name))


def cloud_share(pixels: DataFrame) -> DataFrame:
    return flagged_share(pixels, F.col("qa60") > 0, "cloud_pct")


def snow_share(pixels: DataFrame) -> DataFrame:
    return flagged_share(pixels, index(F.col("b3"), F.col("b11")) > 0.4, "snow_pct")


def at_most(scenes: DataFrame, shares: DataFrame, name: str, threshold: float = 5) -> DataFrame:
    return scenes.join(shares, "image_id").where(F.col(name) <= threshold)


def between(scenes: DataFrame, start: str | None = None, final: str | None = None) -> DataFrame:
    """From `start` on and before `final`."""
    if start:
        scenes = scenes.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    return scenes.where(F.col("ts") < F.lit(final).cast("timestamp")) if final else scenes


def masked_water(pixels: DataFrame, band: str) -> DataFrame:
    """The band's values, null where the water index is above 0."""
    return pixels.withColumn(band, F.when(index(F.col("b3"), F.col("b8")) > 0, None).otherwise(F.col(band)))


def season_sample(scenes: DataFrame, start_year: int, end_year: int, per_year: int, season: tuple[str, str]) -> DataFrame:
    """Of each year's season ('-MM-dd' to '-MM-dd', the end left out) every step-th scene in order of
    (ts, image_id), per_year at most; step = scenes // per_year, all of them if there are no more."""
    year = F.year("ts")
    day = F.to_date("ts")
    inside = (day >= F.to_date(F.concat(year.cast("string"), F.lit(season[0])))) & (day < F.to_date(F.concat(year.cast("string"), F.lit(season[1]))))
    w = Window.partitionBy("year")
    rows = scenes.where(inside & year.between(start_year, end_year)).withColumn("year", year)
    rows = rows.withColumn("i", F.row_number().over(w.orderBy("ts", "image_id")) - 1).withColumn("total", F.count("*").over(w))
    step = F.greatest(F.floor(F.col("total") / per_year), F.lit(1))
    return rows.where((F.col("total") <= per_year) | ((F.col("i") % step == 0) & (F.col("i") / step < per_year))).drop("i", "total")


def one_per_tile_and_day(scenes: DataFrame) -> DataFrame:
    """The first scene (by ts, image_id) of each date and tile."""
    rows = scenes.withColumn("date_tile", F.concat_ws("_", F.date_format("ts", "yyyy-MM-dd"), F.col("tile")))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("date_tile").orderBy("ts", "image_id"))).where("n = 1").drop("n")


def select_scenes(scenes: DataFrame, pixels: DataFrame, roi: tuple[float, float, float, float], years: tuple[int, int], season: tuple[str, str], *, cloud_max: float = 10, per_year: int = 4, cloud_threshold: float | None = 5, snow_threshold: float | None = None, start: str | None = None, final: str | None = None) -> DataFrame:
    """All steps in order, as one lazy plan; the scenes with their date_tile.  A mask for water is no step of its
    own: it changes pixels, by masked_water, and no choice of scenes."""
    rows = covering(scan(scenes, roi, cloud_max), roi)
    if cloud_threshold is not None:
        rows = at_most(rows, cloud_share(pixels), "cloud_pct", cloud_threshold)
    if snow_threshold is not None:
        rows = at_most(rows, snow_share(pixels), "snow_pct", snow_threshold)
    return one_per_tile_and_day(season_sample(between(rows, start, final), *years, per_year, season))
