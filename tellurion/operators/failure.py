"""Failure dates by inverse velocity: a line through 1/v that falls to 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def melted(wide: DataFrame) -> DataFrame:
    """pid, date, velocity from a table with a column D... for each date."""
    days = [c for c in wide.columns if c.startswith("D") and c[1:].isdigit()]
    long = wide.unpivot(["pid"], days, "date_str", "velocity")
    return long.select("pid", F.to_date(F.substring("date_str", 2, 8), "yyyyMMdd").alias("date"), "velocity")


def monthly_inverse(series: DataFrame) -> DataFrame:
    """pid, month, inverse: medians of 1/velocity by month, 0 left out."""
    inverse = series.withColumn("_i", 1 / F.nullif(F.col("velocity"), F.lit(0.0)))
    return inverse.groupBy("pid", F.trunc("date", "MM").alias("month")).agg(F.median("_i").alias("inverse"))


def failures(monthly: DataFrame, points: list[int]) -> DataFrame:
    """pid, n, failure_date for each n of `points`: from a series' last n months, if it has n, two of them
    with a value, and the line falls and meets 0 after the first and before 2100."""
    w = Window.partitionBy("pid")
    rows = monthly.withColumn("r", F.row_number().over(w.orderBy(F.desc("month")))).withColumn("months", F.count("*").over(w))
    rows = rows.withColumn("n", F.explode(F.array(*map(F.lit, points)))).where("months >= n and r <= n and inverse is not null")
    rows = rows.withColumn("t0", F.min("month").over(Window.partitionBy("pid", "n"))).withColumn("t", F.datediff("month", "t0").cast("double"))
    fits = rows.groupBy("pid", "n", "t0").agg(F.count("*").alias("c"), F.regr_slope("inverse", "t").alias("m"), F.regr_intercept("inverse", "t").alias("b")).where("c >= 2 and m < 0")
    # A line that meets 0 at a whole second, midnight mostly, gets there but for the sums' rounding, which is far less
    # than half a thousandth of a second; without this the order of the rows would decide on the day.
    fits = fits.withColumn("seconds", F.round(-F.col("b") / F.col("m") * 86400, 3))
    fits = fits.where((F.col("seconds") > 0) & (F.col("seconds") <= F.datediff(F.lit("2100-01-01").cast("date"), "t0") * 86400.0))
    return fits.select("pid", "n", F.timestamp_seconds(F.unix_seconds(F.col("t0").cast("timestamp")) + F.floor("seconds")).alias("failure_date"))


def failure_months(found: DataFrame) -> DataFrame:
    return found.groupBy("n", F.date_format("failure_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("cnt"))


def likeliest(months: DataFrame) -> DataFrame:
    """Of each n the month with most failures, the earliest of equals; nothing without any."""
    return months.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("cnt"), "month"))).where("r = 1").drop("r")
