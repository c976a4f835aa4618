"""Files that the engine reads and writes, all by Spark's own readers and writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import scaled_8bit

METADATA = "Image_ID string, Date string, Cloud_Cover double, Orbit_Number int, Tile_ID string, Status string"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The scenes' table (CSV with a header), with `date`; those marked as removed are left out, a missing
    Status counts as kept."""
    rows = spark.read.schema(METADATA).option("enforceSchema", False).csv(path, header=True)
    return rows.where(F.coalesce("Status", F.lit("kept")) == "kept").withColumn("date", F.to_date("Date"))


def write_metadata(scenes: DataFrame, path: str, keep: list[int] | None = None) -> None:
    """With Status: kept, or removed for the scenes whose idx isn't in `keep`."""
    status = F.lit("kept") if keep is None else F.when(F.col("idx").isin(keep), "kept").otherwise("removed")
    names = [c.split()[0] for c in METADATA.split(", ")]
    scenes.withColumn("Status", status).select(*names).write.mode("overwrite").csv(path, header=True)


def write_pixels(pixels: DataFrame, path: str) -> None:
    """A stack in long form, a folder for each scene, so that a pair reads two of them."""
    pixels.write.mode("overwrite").partitionBy("scene").parquet(path)


def write_composite(stack: DataFrame, path: str, keep: list[int] | None = None) -> None:
    """The scenes kept, each stretched to 8 bits."""
    write_pixels(scaled_8bit(stack if keep is None else stack.where(F.col("scene").isin(keep))), path)


def write_bands(grid: DataFrame, path: str) -> None:
    """A grid for each date, a folder for each."""
    grid.write.mode("overwrite").partitionBy("date").parquet(path)


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """Wide velocities (CSV): pid and a column D... for each date, all numbers but pid."""
    rows = spark.read.csv(path, header=True)
    return rows.select("pid", *[F.col(c).cast("double") for c in rows.columns if c.startswith("D") and c[1:].isdigit()])


def write_wide(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True)


def predictions(spark: SparkSession, folder: str, method: str, match: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The displacements stored for a method and match function; computed and stored where there are none."""
    path = f"{folder}/{method}_{match}.parquet"
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise  # what is there can't be read: not to be hidden by computing it anew
        compute().write.parquet(path)
        return spark.read.parquet(path)


def to_ground(x, y, affine: tuple[float, float, float, float, float, float]):
    """Ground coordinates of a pixel's middle: x' = a x + b y + c, y' = d x + e y + f."""
    a, b, c, d, e, f = affine
    return a * (x + 0.5) + b * (y + 0.5) + c, d * (x + 0.5) + e * (y + 0.5) + f


def grid_affines(affine: tuple[float, float, float, float, float, float], shape: tuple[int, int], grid: tuple[int, int], block: int, step: int) -> tuple[tuple, tuple]:
    """Two ways to place a grid on its image: stretched over the whole image, and shifted to the middle of the
    first block with one cell a step."""
    a, b, c, d, e, f = affine
    sy, sx = shape[0] / grid[0], shape[1] / grid[1]
    o = block / 2
    return (a * sx, b * sy, c, d * sx, e * sy, f), (a * step, b * step, a * o + b * o + c, d * step, e * step, d * o + e * o + f)
