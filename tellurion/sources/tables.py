"""Tables as the engine's inputs, and views that give other tables its shapes (scenes, displacements, ...).

NaN becomes null where measurements come in: no median, comparison or bin of the engine meets one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measured(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of measurements: NaN becomes null on the way in."""
    return without_nan(table(spark, sf_dir, name))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null, in columns of numbers and in arrays of them."""
    def clean(c: Column, kind: str) -> Column:
        if kind.startswith("array<"):
            return F.transform(c, lambda x: clean(x, kind[6:-1]))
        return F.nullif(c, F.lit(float("nan")).cast(kind))

    kinds = ("double", "float", "array<double>", "array<float>")
    return df.withColumns({c: clean(F.col(c), t) for c, t in df.dtypes if t in kinds})


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, ts, cloud (0 to 100), tile, xmin, ymin, xmax, ymax."""
    o = table(spark, sf_dir, "orders")
    x0, y0 = (F.col("o_custkey") % 10).cast("double"), (F.col("o_orderkey") % 7).cast("double")
    price = F.col("o_totalprice")
    return o.select(F.col("o_orderkey").alias("image_id"), F.col("o_orderdate").alias("ts"), (price - 100 * F.floor(price / 100)).alias("cloud"), (F.col("o_custkey") % 5).alias("tile"), x0.alias("xmin"), y0.alias("ymin"), (x0 + 12).alias("xmax"), (y0 + 9).alias("ymax"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, b3, b8, b11, qa60: line items as a scene's pixels."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_quantity").alias("b3"), (F.col("l_discount") * 100).alias("b11"), (F.col("l_tax") * 500).alias("b8"), F.when(F.col("l_returnflag") == "R", 1024).otherwise(0).alias("qa60"))


def displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, pt_idx (the point's place in its pair), x, y, u, v, pkr, snr.  Some pkr and snr are null."""
    li = measured(spark, sf_dir, "lineitem")
    d = li.select((F.col("l_orderkey") % 40).cast("int").alias("pair_id"), (F.col("l_partkey") % 50).cast("int").alias("x"), (F.col("l_suppkey") % 40).cast("int").alias("y"), ((F.col("l_discount") - 0.05) * 100).alias("u"), ((F.col("l_tax") - 0.04) * 100).alias("v"), (1 + F.nullif(F.col("l_quantity"), F.lit(7.0)) / 50).alias("pkr"), (F.nullif(F.col("l_quantity"), F.lit(9.0)) / 5).alias("snr"))
    order = Window.partitionBy("pair_id").orderBy("x", "y", "u", "v", "pkr", "snr")
    return d.withColumn("pt_idx", F.row_number().over(order) - 1)


def pair_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, years: the 40 pairs' separations."""
    return spark.range(40).select(F.col("id").cast("int").alias("pair_id"), (1 + F.col("id") % 8 / 2).cast("double").alias("years"))


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, dem, slope, aspect: parts as pixels of a raster 50 wide."""
    p = measured(spark, sf_dir, "part")
    return p.select(F.floor(F.col("p_partkey") / 50).cast("int").alias("y"), (F.col("p_partkey") % 50).cast("int").alias("x"), F.col("p_retailprice").alias("dem"), F.col("p_size").cast("double").alias("slope"), (F.col("p_size") * 7 % 360).cast("double").alias("aspect"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point, pair_id, d1, d2, v, pkr, snr: from each event of a user to the next."""
    e = measured(spark, sf_dir, "events")
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("point"), F.col("event_id").alias("pair_id"), F.to_date("ts").alias("d1"), F.to_date(nxt).alias("d2"), F.col("value").alias("v"), (1 + F.col("event_id") % 7 / 10).alias("pkr"), (1 + F.col("event_id") % 11).cast("double").alias("snr")).where("d2 is not null")


def long_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point, d1, d2, u, v, pkr, snr: from order to shipping; some end before they begin."""
    li, o = measured(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("l_suppkey").alias("point"), F.to_date("o_orderdate").alias("d1"), F.to_date("l_shipdate").alias("d2"), ((F.col("l_tax") - 0.04) * 100).alias("u"), ((F.col("l_discount") - 0.05) * 100).alias("v"), (1 + F.col("l_quantity") / 50).alias("pkr"), (F.col("l_quantity") / 5).alias("snr"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, date, velocity (zeros among them): a series for each supplier."""
    li = measured(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("pid"), F.to_date("l_shipdate").alias("date"), ((F.col("l_discount") - 0.05) * 10).alias("velocity"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block_id, a, b: each vector as 8 by 8 pixels, row by row, with the next one."""
    e = measured(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select(F.col("vec_id").alias("block_id"), F.col("e").alias("a")).join(e.select((F.col("vec_id") - 1).alias("block_id"), F.col("e").alias("b")), "block_id")
