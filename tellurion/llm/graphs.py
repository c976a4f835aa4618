"""Connected components of links held as a table, never on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """`links`: columns a and b, two numbers each.  Returns id and class for every id in a link; the class
    is the smallest id that links lead to.  Nulls and links of an id to itself are left out.

    Alternating large-star and small-star steps: each links the neighbours of a node to the smallest of
    them, so that every component ends as a star around its smallest id.  Each step is a group-by on
    narrow rows whose minimum is taken on the map side; nothing gathers a node's neighbours in one place.
    Every step is written, so lineage stays short and a lost executor costs one step."""
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "links")
    while True:
        # Done if every id is linked to one other, which is linked to none itself.
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("n")), F.struct(F.col("b").alias("id"), F.lit(0).alias("n")))).alias("e")).select("e.*")
        if not ends.groupBy("id").agg(F.sum("n").alias("n"), F.min("n").alias("least")).where("n > 1 or (n = 1 and least = 0)").take(1):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = small.select("a", F.explode(F.array(F.col("m"), F.col("b"))).alias("b"), "m").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.distinct(), "star")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("class")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("class")).distinct())
