"""Pairs of scene dates by their separation, as a range join over buckets of years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

YEAR = 365.25


def date_pairs(dates: DataFrame, least: float = 1, most: float = 5, reference: str | None = None) -> DataFrame:
    """dat1, dat2, sep (years), with least < sep < most and, if given, dat1 < reference < dat2.

    `dates`: a column `date`, each date once.  Each first date meets only the buckets of `most` years that
    its partners can lie in: an equi-join, not a product of all dates."""
    width = max(1, int(most * YEAR) + 1)
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / width)
    a = dates.select(F.col("date").alias("dat1"), F.explode(F.array(bucket(F.col("date")), bucket(F.col("date")) + 1)).alias("k"))
    b = dates.select(F.col("date").alias("dat2"), bucket(F.col("date")).alias("k"))
    sep = F.datediff("dat2", "dat1") / F.lit(YEAR)
    pairs = a.join(b, "k").withColumn("sep", sep).where((F.col("sep") > least) & (F.col("sep") < most)).drop("k")
    if reference:
        pairs = pairs.where((F.col("dat1") < F.lit(reference).cast("date")) & (F.col("dat2") > F.lit(reference).cast("date")))
    return pairs


def numbered(pairs: DataFrame) -> DataFrame:
    """With pair_id in the order of (dat1, dat2)."""
    return pairs.withColumn("pair_id", F.row_number().over(Window.orderBy("dat1", "dat2")) - 1)


def date_index(scenes: DataFrame) -> DataFrame:
    """date, idx: of scenes of one date the last one's number."""
    return scenes.groupBy("date").agg(F.max("idx").alias("idx"))


def with_indexes(pairs: DataFrame, scenes: DataFrame) -> DataFrame:
    """idx1 and idx2 of each pair's scenes; pairs without both are left out."""
    i = date_index(scenes)
    pairs = pairs.join(i.select(F.col("date").alias("dat1"), F.col("idx").alias("idx1")), "dat1")
    return pairs.join(i.select(F.col("date").alias("dat2"), F.col("idx").alias("idx2")), "dat2")
