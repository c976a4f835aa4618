"""Helpers shared by the corpus operators: reading tables, cutting lineage, bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests) a temporary one is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tellurion-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` written as a table in the shared folder and read again: its lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], by: str, how: str = "inner", ways: int = 8) -> DataFrame:
    """`many` joined with `few`, which has a row for each key.  The rows of a key are dealt to `ways` tasks by
    a hash of their column `by`, so that a key which holds a large share of all rows isn't one task."""
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(by, F.lit(5)), F.lit(ways)).cast("int"))
    repeated = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the rows of a batch that goes to Python, which Spark counts without regard to their size:
    whole texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


_held: dict = {}


def held_by_worker(key: object, build: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: one thing at a time, so that the tables of one operator
    make room for the next one's."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def drop_held() -> None:
    """Makes room in this Python worker for a table that isn't held here, such as a broadcast one."""
    _held.clear()


def unit_hash(*cols: Column) -> Column:
    """A number from 0 to 1 that depends on the given columns alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def bounded_by_class(df: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """Rows of `df` whose hashed key lies below a rate set per class: about `per_class` rows of each
    class, or all it has.  Classes are counted over all rows; the rows kept don't depend on the
    partitioning.  The number of classes is taken to be small (languages, grades)."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect() if r[0] is not None}
    rate = F.lit(0.0)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        rate = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(rate)
    return df.where(F.col(label).isNotNull() & (unit_hash(F.col(key).cast("string"), F.lit("sample")) < rate))
