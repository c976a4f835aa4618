"""Velocity series of points: midpoints, daily medians, least squares; calendar bins; wide export."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_table(d: DataFrame, pairs: DataFrame, points: DataFrame, pixel_size: float = 10.0) -> DataFrame:
    """Displacements of the given points with their pair's dates: u_values and v_values in metres with the
    sign turned, velocities in metres a year with the sign kept.  `pairs`: pair_id, dat1, dat2, years."""
    rows = d.join(points, ["x", "y"], "left_semi").join(pairs, "pair_id").where("years > 0")
    return rows.withColumns({f"{c}_values": -F.col(c) * pixel_size for c in ("u", "v")} | {f"{c}_velocity": F.col(c) * pixel_size / F.col("years") for c in ("u", "v")})


def interval_grid(d: DataFrame, pairs: DataFrame, points: DataFrame, pixel_size: float = 10.0) -> DataFrame:
    """A row for each of the points and each pair: what `interval_table` has, or nulls where the pair has no
    displacement of the point.  Displacements stay and velocities are null where the years aren't above 0.
    The result has points x pairs rows by what it is."""
    found = d.join(points, ["x", "y"], "left_semi").groupBy("pair_id", "x", "y").agg(F.max_by(F.struct("u", "v", "pkr", "snr"), "pt_idx").alias("_d")).select("pair_id", "x", "y", "_d.*")
    rows = points.select("x", "y").distinct().crossJoin(pairs).join(found, ["pair_id", "x", "y"], "left")
    years = F.when(F.col("years") > 0, F.col("years"))
    rows = rows.withColumns({f"{c}_values": -F.col(c) * pixel_size for c in ("u", "v")} | {f"{c}_velocity": F.col(c) * pixel_size / years for c in ("u", "v")})
    here = F.col("u").isNotNull() | F.col("v").isNotNull()
    return rows.withColumns({c: F.when(here, F.col(c)) for c in pairs.columns if c != "pair_id"})


def good(rows: DataFrame, snr: float | None = None, pkr: float | None = None, forward: bool = True, value: str = "v") -> DataFrame:
    """Rows with a value, the quality asked for and (`forward`) a second date after the first."""
    rows = rows.where(F.col(value).isNotNull())
    for name, t in (("snr", snr), ("pkr", pkr)):
        if t is not None:
            rows = rows.where(F.col(name) >= t)
    return rows.where("d2 > d1") if forward else rows


def midpoints(rows: DataFrame, snr: float | None = None, pkr: float | None = None) -> DataFrame:
    """point, at (the middle of the interval, maybe noon), v.  Rows that end before they begin stay."""
    half = (F.unix_seconds(F.col("d1").cast("timestamp")) + F.unix_seconds(F.col("d2").cast("timestamp"))) / 2
    return good(rows, snr, pkr, False).select("point", F.timestamp_seconds(half).alias("at"), "v")


def month_number(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c) - 1


def month_end(number: Column) -> Column:
    return F.last_day(F.make_date(F.floor(number / 12).cast("int"), (F.pmod(number, F.lit(12)) + 1).cast("int"), F.lit(1)))


def binned(series: DataFrame, at: str, months: int, calendar_years: bool = False) -> DataFrame:
    """point, date, velocity: medians of bins of `months` months.  The first bin is the first month alone;
    bins end with months; empty bins between are null.  With `calendar_years`, bins are years."""
    s = series.select("point", month_number(F.col(at)).alias("m"), "v")
    if calendar_years:
        s = s.withColumn("k", F.floor(F.col("m") / 12) - F.floor(F.min("m").over(Window.partitionBy("point")) / 12)).withColumn("m0", F.floor(F.min("m").over(Window.partitionBy("point")) / 12) * 12 + 11)
        months = 12
    else:
        s = s.withColumn("m0", F.min("m").over(Window.partitionBy("point"))).withColumn("k", F.ceil((F.col("m") - F.col("m0")) / months))
    bins = s.groupBy("point", "m0", F.col("k").cast("int").alias("k")).agg(F.median("v").alias("velocity"))
    every = bins.groupBy("point", "m0").agg(F.max("k").alias("last")).select("point", "m0", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("k"))
    return every.join(bins, ["point", "m0", "k"], "left").select("point", month_end(F.col("m0") + F.col("k") * months).alias("date"), "velocity")


def daily(rows: DataFrame, snr: float | None = None, pkr: float | None = None) -> DataFrame:
    """point, at, v: for each day the median of the intervals that cover it, both ends included."""
    days = good(rows, snr, pkr).select("point", F.explode(F.sequence("d1", "d2")).alias("at"), "v")
    return days.groupBy("point", "at").agg(F.median("v").alias("v"))


def merged(u: DataFrame, v: DataFrame, smoothed: bool = False) -> DataFrame:
    """point, date, u_velocity, v_velocity, formatted_date: all dates of either, at month ends.  `smoothed`:
    their smoothed_velocity where they have one."""
    of = lambda s: F.col("smoothed_velocity" if smoothed and "smoothed_velocity" in s.columns else "velocity")
    both = u.select("point", "date", of(u).alias("u_velocity")).join(v.select("point", "date", of(v).alias("v_velocity")), ["point", "date"], "full_outer")
    return both.withColumn("date", F.last_day("date")).withColumn("formatted_date", F.concat(F.lit("D"), F.date_format("date", "yyyyMMdd")))


def least_squares(rows: DataFrame, snr: float | None = None, pkr: float | None = None, weight: str | None = None, step_months: int | None = None) -> DataFrame:
    """point, at, v: the amounts per time step (a day, or month ends every `step_months`) whose sums over
    each interval come nearest to what it moved, the least such.  One task solves a point; a point's
    system has a column for each run of steps that its intervals don't separate: twice as many as intervals
    at most, however many days they span."""
    freq = "D" if step_months is None else f"{step_months}ME"

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pd.to_datetime(pdf["d1"]), pd.to_datetime(pdf["d2"])
        steps = pd.date_range(a.min(), b.max(), freq=freq)
        moved = pdf["v"].to_numpy(dtype=float) * ((b - a).dt.days.to_numpy() + 1) / 365.25
        first, end = np.searchsorted(steps.values, a.values), np.searchsorted(steps.values, b.values, side="right")
        hit = end > first
        if not hit.any() or not len(steps):
            return pd.DataFrame({"point": [], "at": [], "v": []})
        # Steps that no interval separates have one column, and of the least solution equal parts of its value.
        cuts = np.unique(np.concatenate([first[hit], end[hit]]))
        width = np.diff(cuts)
        covers = ((cuts[None, :-1] >= first[hit, None]) & (cuts[None, 1:] <= end[hit, None])) * np.sqrt(width)
        moved = moved[hit]
        if weight:
            w = pdf[weight].to_numpy(dtype=float)[hit]
            w = np.sqrt(np.where(w > 0, w, 1.0))
            covers, moved = covers * w[:, None], moved * w
        x = np.zeros(len(steps))
        x[cuts[0] : cuts[-1]] = np.repeat(np.linalg.lstsq(covers, moved, rcond=None)[0] / np.sqrt(width), width)
        return pd.DataFrame({"point": pdf["point"].iloc[0], "at": steps.date, "v": x})

    return good(rows, snr, pkr).groupBy("point").applyInPandas(solved, "point long, at date, v double")


def velocity_series(rows: DataFrame, method: str = "weighted", months: int = 4, snr: float | None = 3, pkr: float | None = 1.3, weight: str | None = None, step_months: int | None = 6) -> DataFrame:
    """u and v series by one of the methods, merged."""
    def one(c: str) -> DataFrame:
        r = rows.withColumn("v", F.col(c))
        if method == "midpoint":
            return binned(midpoints(r, snr, pkr), "at", months)
        if method == "weighted":
            return binned(daily(r, snr, pkr), "at", months, months == 12)
        if method == "lsqr":
            return binned(least_squares(r, snr, pkr, weight, step_months), "at", months, months == 12)
        raise ValueError(f"no such method: {method}")

    return merged(one("u"), one("v"))


def cubic_rmse(series: DataFrame, value: str = "velocity") -> DataFrame:
    """point, rmse of a cubic in the row's ordinal: null for fewer than 2 values, 0 for 2 to 4.

    The residual of each power in turn: a power is made orthogonal to the lower ones, and what the values have
    of it is taken from them.  All sums are windows over one partitioning by point."""
    at, whole = Window.partitionBy("point").orderBy("date"), Window.partitionBy("point")
    s = series.select("point", "date", F.col(value).alias("e")).withColumn("i", F.row_number().over(at)).where("e is not null")
    s = s.withColumns({"n": F.count("*").over(whole), "t": (F.col("i") - F.min("i").over(whole)) / F.nullif(F.max("i").over(whole) - F.min("i").over(whole), F.lit(0))})
    part = lambda a, b: F.coalesce(F.sum(F.col(a) * F.col(b)).over(whole) / F.nullif(F.sum(F.col(b) * F.col(b)).over(whole), F.lit(0.0)), F.lit(0.0)) * F.col(b)
    s = s.withColumns({"p0": F.lit(1.0), "e": F.col("e") - F.avg("e").over(whole)})
    for k in (1, 2, 3):
        s = s.withColumn(f"p{k}", F.col("t") ** k)
        for j in range(k):
            s = s.withColumn(f"p{k}", F.col(f"p{k}") - part(f"p{k}", f"p{j}"))
        s = s.withColumn("e", F.col("e") - part("e", f"p{k}"))
    rmse = F.when(F.max("n") > 4, F.sqrt(F.avg(F.col("e") * F.col("e")))).when(F.max("n") > 1, F.lit(0.0))
    return series.select("point").distinct().join(s.groupBy("point").agg(rmse.alias("rmse")), "point", "left")


def half_even(c: Column, digits: int) -> Column:
    """Rounded half to even, by the first 9 digits: what lies beyond is the noise of sums and makes no tie."""
    return F.bround(F.round(c, 9), digits)


def point_id(point: Column) -> Column:
    """An id that is the same on every run: OT and 8 characters of the point's digest."""
    return F.concat(F.lit("OT"), F.upper(F.substring(F.sha2(point.cast("string"), 256), 1, 8)))


def wide(series: DataFrame, component: Column, dates: list[str], places: DataFrame | None = None) -> DataFrame:
    """One row for each point: point, pid, median_velocity, rmse and a column D... for each of `dates`
    (yyyyMMdd); rounded half to even, to 1, 2 and 1 digits.  With `places` (point, x, y, longitude, latitude)
    these too."""
    s = series.withColumn("_v", component)
    pivot = s.groupBy("point").pivot("formatted_date", [f"D{d}" for d in dates]).agg(half_even(F.first("_v", True), 1))
    stats = s.groupBy("point").agg(half_even(F.median("_v"), 1).alias("median_velocity"))
    rmse = cubic_rmse(s, "_v").withColumn("rmse", half_even(F.col("rmse"), 2))
    out = stats.join(rmse, "point").withColumn("pid", point_id(F.col("point")))
    out = out if places is None else out.join(places.select("point", "x", "y", "longitude", "latitude"), "point")
    return out.join(pivot, "point")


def mean_speed(we: DataFrame, ns: DataFrame) -> DataFrame:
    """pid, speed: the mean over time steps of the length of the two components, of the points in both of two
    long tables pid, date, velocity."""
    both = we.select("pid", "date", F.col("velocity").alias("_u")).join(ns.select("pid", "date", F.col("velocity").alias("_v")), ["pid", "date"])
    return both.groupBy("pid").agg(F.avg(F.hypot("_u", "_v")).alias("speed"))


def magnitude(u: str = "u_velocity", v: str = "v_velocity") -> Column:
    return F.hypot(u, v)


def fastest(medians: DataFrame, n: int = 10) -> DataFrame:
    return medians.orderBy(F.desc("median_velocity"), "point").limit(n)


def multiband(series: DataFrame, points: DataFrame) -> DataFrame:
    """band, date, gy, gx, mag: a band for each date of all points; -9999 where a cell has no value."""
    bands = series.select("date").distinct().withColumn("band", F.row_number().over(Window.orderBy("date")))  # as many rows as time steps
    cells = points.select("gy", "gx").distinct()
    mags = series.join(points, "point").groupBy("date", "gy", "gx").agg(F.max(magnitude()).alias("mag"))
    spread = cells.crossJoin(bands)  # the grid of all bands, which is what the result is
    return spread.join(mags, ["date", "gy", "gx"], "left").select("band", "date", "gy", "gx", F.coalesce("mag", F.lit(-9999.0)).alias("mag"))


def largest(bands: DataFrame, first: int = 2, none: tuple[float, ...] = (0.0, -9999.0)) -> DataFrame:
    """The largest mag of the bands from `first` on, without the values that stand for none."""
    return bands.where((F.col("band") >= first) & ~F.col("mag").isin(*none)).agg(F.max("mag").alias("mag"))
