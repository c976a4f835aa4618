"""Array and angle expressions that several operators share; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def array_median(a: Column) -> Column:
    """The median of an array's non-null numbers; null without any."""
    s = F.array_sort(F.filter(a, lambda x: x.isNotNull()))
    n = F.size(s)
    middle = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, middle)


def gaussian_weights(sigma: float) -> list[float]:
    radius = int(4 * sigma + 0.5)
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def computed_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """`rows` with further columns that the optimizer doesn't repeat wherever they are used, in filters too:
    a generator of one row stands between them and what follows.  For expressions over whole arrays."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    kept = [c for c in rows.columns if c not in columns]
    return rows.select("*", one.alias("_once")).select(*kept, *[F.col("_once")[n].alias(n) for n in columns])


#: Rows of a window's key at most, but for the few that reach over from its neighbours.
RANGE = 65536


def in_ranges(rows: DataFrame, place: str, back: int, ahead: int) -> DataFrame:
    """`rows` dealt to ranges of their `place` (0, 1, 2, ... within a key), for windows that reach `back` and
    `ahead` rows: with _range, and _own, which is false for the rows that a range borrows from its neighbours.
    A window over a long series is then many tasks, and gives the same values for the rows that are _own."""
    at, size = F.col(place), max(RANGE, back + ahead)
    k, rest = F.floor(at / size), at % size
    ranges = F.array_compact(F.array(k, F.when((rest < ahead) & (k > 0), k - 1), F.when(rest >= size - back, k + 1)))
    dealt = rows.withColumn("_range", F.explode(ranges))
    return dealt.withColumn("_own", F.col("_range") == F.floor(at / size))


def frame(value: Column, partition: list[str], order: str, back: int, ahead: int) -> Column:
    """The values of the rows around each row, as an array of structs (so that nulls stay)."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(-back, ahead)
    return F.collect_list(F.struct(value.alias("v"))).over(w)


def reflected(j: Column, n: Column) -> Column:
    """An index mirrored at the edges of 0..n-1, the edge repeated."""
    m = F.pmod(j, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def clamped(j: Column, n: Column) -> Column:
    return F.least(F.greatest(j, F.lit(0)), n - 1)


def turned(degrees: Column) -> Column:
    """The smaller angle, 0 to 180."""
    d = F.pmod(degrees, F.lit(360.0))
    return F.least(d, 360.0 - d)
