"""Matching of image blocks: correlation surfaces, peaks with their quality, parts of a pixel.

The normalised correlation is an expression over arrays (by Parseval it is the circular correlation of the
blocks); the phase correlation needs a transform and runs over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import computed_once
from . import flow
from .displacement import filter_pairs
from .raster import stride

SUBPIXEL = ("none", "parabolic", "center_of_mass", "gaussian", "os3", "os5", "os7", "ipg", "ensemble")


def centred(a: Column) -> Column:
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    return F.transform(a, lambda x: x - mean)


#: From this size on the correlation goes by a transform over Arrow batches: the expression takes size ** 4 steps.
BY_TRANSFORM = 16


def ncc_surface(blocks: DataFrame, size: int) -> DataFrame:
    """Adds c: the correlation for every shift, row by row, shift 0 at (size // 2, size // 2); nulls for a flat
    block."""
    return ncc_by_transform(blocks, size) if size >= BY_TRANSFORM else ncc_by_expression(blocks, size)


def _images(blocks: pd.Series, size: int) -> np.ndarray:
    return np.stack(blocks.to_list()).reshape(-1, size, size) if len(blocks) else np.zeros((0, size, size))


def ncc_by_transform(blocks: DataFrame, size: int) -> DataFrame:
    @F.pandas_udf("array<double>")
    def surface(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (s - s.mean(axis=(1, 2), keepdims=True) for s in (_images(a, size), _images(b, size)))
        scale = np.sqrt((x * x).sum((1, 2)) * (y * y).sum((1, 2))) * size * size
        c = np.fft.fftshift(np.real(np.fft.ifft2(np.fft.fft2(x) * np.conj(np.fft.fft2(y)))), axes=(1, 2)).reshape(len(x), size * size)
        return pd.Series([c[k] / scale[k] if scale[k] > 0 else None for k in range(len(c))], dtype=object)

    return blocks.withColumn("c", surface("a", "b"))


def ncc_by_expression(blocks: DataFrame, size: int) -> DataFrame:
    b = blocks.withColumns({"_a": centred(F.col("a")), "_b": centred(F.col("b"))})
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    half, n = size // 2, size * size
    at = lambda s, p, off: F.pmod(F.floor(p / size) + F.floor(s / size) - off, F.lit(size)) * size + F.pmod(p % size + s % size - off, F.lit(size))
    shift = lambda s: F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda t, p: t + F.get("_a", at(s, p, half).cast("int")) * F.get("_b", p))
    scale = F.nullif(norm(F.col("_a")) * norm(F.col("_b")) * n, F.lit(0.0))
    b = computed_once(b, _a=F.col("_a"), _b=F.col("_b"), _k=scale)
    return computed_once(b, c=F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: shift(s) / F.col("_k"))).drop("_a", "_b", "_k")


def peaks(surfaces: DataFrame, size: int) -> DataFrame:
    """Adds i, j (the first largest place), dx, dy, u, v, snr (peak by mean of absolutes), pkr (peak by the
    largest outside the 3 by 3 around it)."""
    top = F.array_max("c")
    s = surfaces.withColumn("_p", F.array_position("c", top) - 1).withColumns({"i": F.floor(F.col("_p") / size).cast("int"), "j": (F.col("_p") % size).cast("int")})
    mean = F.aggregate("c", F.lit(0.0), lambda t, x: t + F.abs(x)) / (size * size)
    others = F.filter("c", lambda x, k: (F.abs(F.floor(k / size) - F.col("i")) > 1) | (F.abs(k % size - F.col("j")) > 1))
    s = s.withColumns({"snr": top / (mean + 1e-10), "pkr": top / (F.array_max(others) + 1e-10)})
    s = computed_once(s, **{c: F.col(c) for c in ("i", "j", "snr", "pkr")}).drop("_p")
    return s.withColumns({"dy": F.col("i") - size // 2, "dx": F.col("j") - size // 2}).withColumns({"u": -F.col("dx"), "v": -F.col("dy")})


def _at(i: Column, j: Column, size: int) -> Column:
    inside = (i >= 0) & (i < size) & (j >= 0) & (j < size)
    return F.when(inside, F.get("c", (i * size + j).cast("int")))


def parabolic(size: int) -> tuple[Column, Column]:
    """Offsets (y, x) of a parabola through three values; 0 at edges and on flat tops."""
    i, j = F.col("i"), F.col("j")

    def one(a: Column, b: Column, c: Column) -> Column:
        return F.coalesce((a - c) / (2 * F.nullif(a - 2 * b + c, F.lit(0.0))), F.lit(0.0))

    mid = _at(i, j, size)
    return one(_at(i - 1, j, size), mid, _at(i + 1, j, size)), one(_at(i, j - 1, size), mid, _at(i, j + 1, size))


def centre_of_mass(size: int) -> tuple[Column, Column]:
    """Offsets (y, x) of the mass of the 3 by 3 around the peak; 0 at edges."""
    i, j = F.col("i"), F.col("j")
    nine = [(dy, dx, _at(i + dy, j + dx, size)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    total = sum((c for _, _, c in nine), F.lit(0.0))
    part = lambda k: F.coalesce(sum((x[k] * x[2] for x in nine), F.lit(0.0)) / F.nullif(total, F.lit(0.0)), F.lit(0.0))
    return part(0), part(1)


def log_parabolic(size: int) -> tuple[Column, Column]:
    """Offsets (y, x) of a Gaussian through three values, at most 1; 0 at edges and on flat tops."""
    i, j = F.col("i"), F.col("j")
    ln = lambda c: F.ln(F.greatest(c, F.lit(1e-10)))

    def one(a: Column, b: Column, c: Column) -> Column:
        x = (ln(a) - ln(c)) / (2 * F.nullif(ln(a) - 2 * ln(b) + ln(c), F.lit(0.0)))
        ok = a.isNotNull() & c.isNotNull() & x.isNotNull()
        return F.coalesce(F.when(ok, F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))), F.lit(0.0))

    mid = _at(i, j, size)
    return one(_at(i - 1, j, size), mid, _at(i + 1, j, size)), one(_at(i, j - 1, size), mid, _at(i, j + 1, size))


def centred_mass(size: int, width: int) -> tuple[Column, Column]:
    """Offsets (y, x) of the mass of a window around the surface's middle, less its mean and not below 0."""
    half, mid = width // 2, size // 2
    cells = [(dy, dx, F.get("c", F.lit((mid + dy) * size + mid + dx))) for dy in range(-half, half + 1) for dx in range(-half, half + 1)]
    others = [c for dy, dx, c in cells if (dy, dx) != (0, 0)]
    mean = sum(others, F.lit(0.0)) / len(others)
    weights = [(dy, dx, F.greatest(c - mean, F.lit(0.0))) for dy, dx, c in cells]
    total = F.nullif(sum((w for *_, w in weights), F.lit(0.0)), F.lit(0.0))
    return tuple(F.coalesce(sum((x[k] * x[2] for x in weights), F.lit(0.0)) / total, F.lit(0.0)) for k in (0, 1))


def gradient_step(size: int) -> tuple[Column, Column]:
    """Offsets (y, x) of one Newton step from the surface's middle; 0 if ill-conditioned or longer than 2."""
    mid = size // 2
    at = lambda dy, dx: F.get("c", F.lit((mid + dy) * size + mid + dx))
    gy, gx = (at(1, 0) - at(-1, 0)) / 2, (at(0, 1) - at(0, -1)) / 2
    yy, xx = at(1, 0) - 2 * at(0, 0) + at(-1, 0), at(0, 1) - 2 * at(0, 0) + at(0, -1)
    xy = (at(1, 1) - at(1, -1) - at(-1, 1) + at(-1, -1)) / 4
    det, mean, root = xx * yy - xy * xy, (xx + yy) / 2, F.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    big, small = F.greatest(F.abs(mean + root), F.abs(mean - root)), F.least(F.abs(mean + root), F.abs(mean - root))
    dx, dy = -(yy * gx - xy * gy) / F.nullif(det, F.lit(0.0)), -(xx * gy - xy * gx) / F.nullif(det, F.lit(0.0))
    ok = (big <= 1e3 * small) & (F.hypot(dx, dy) <= 2)
    return F.when(ok, dy).otherwise(F.lit(0.0)), F.when(ok, dx).otherwise(F.lit(0.0))


def refined(matches: DataFrame, size: int, method: str = "parabolic") -> DataFrame:
    """u and v with the part of a pixel.  gaussian, os*, ipg and ensemble leave out the whole pixels."""
    if method not in SUBPIXEL:
        raise ValueError(f"no such method: {method}")
    if method == "none":
        return matches
    oy, ox = {"parabolic": parabolic, "center_of_mass": centre_of_mass, "gaussian": log_parabolic, "ipg": gradient_step}[method](size) if method in ("parabolic", "center_of_mass", "gaussian", "ipg") else centred_mass(size, int(method[2:]) if method != "ensemble" else 3)
    if method == "ensemble":  # its two members weigh the same
        py, px = parabolic(size)
        oy, ox = (oy + py) / 2, (ox + px) / 2
    whole = method in ("parabolic", "center_of_mass")
    dy, dx = (F.col("dy") + oy, F.col("dx") + ox) if whole else (oy, ox)
    return matches.withColumns({"u": -dx, "v": -dy})


def match_ncc(blocks: DataFrame, size: int, method: str = "parabolic") -> DataFrame:
    return refined(peaks(ncc_surface(blocks, size), size), size, method)


def pcc_surface(blocks: DataFrame, size: int) -> DataFrame:
    """Adds c by phase correlation: the spectra's product over its absolute value, transformed back."""
    @F.pandas_udf("array<double>")
    def surface(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = np.fft.fft2(_images(a, size)), np.fft.fft2(_images(b, size))
        cross = x * np.conj(y)
        c = np.fft.fftshift(np.real(np.fft.ifft2(cross / (np.abs(cross) + 1e-10))), axes=(1, 2))
        return pd.Series(list(c.reshape(len(c), -1)))

    return blocks.withColumn("c", surface("a", "b"))


def match_pcc(blocks: DataFrame, size: int, method: str = "parabolic") -> DataFrame:
    return refined(peaks(pcc_surface(blocks, size), size), size, method)


def match_upsampled(blocks: DataFrame, size: int, factor: int = 10) -> DataFrame:
    """u, v from phase correlation evaluated at every 1/factor pixel around its peak; no pkr or snr."""
    @F.pandas_udf("u double, v double")
    def found(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        freq, fine = np.fft.fftfreq(size), np.arange(-1.5 * factor, 1.5 * factor + 1) / factor
        cross = np.fft.fft2(_images(a, size)) * np.conj(np.fft.fft2(_images(b, size)))
        cross = cross / np.maximum(np.abs(cross), 100 * np.finfo(float).eps)
        peak = np.abs(np.fft.ifft2(cross)).reshape(len(cross), size * size).argmax(axis=1)
        base = np.stack([peak // size, peak % size])
        base = np.where(base > size // 2, base - size, base)
        ey, ex = (np.exp(2j * np.pi * (base[k][:, None, None] + fine[None, :, None]) * freq[None, None, :]) for k in (0, 1))
        best = np.abs(ey @ cross @ ex.transpose(0, 2, 1)).reshape(len(cross), len(fine) ** 2).argmax(axis=1)
        return pd.DataFrame({"u": -(base[1] + fine[best % len(fine)]), "v": -(base[0] + fine[best // len(fine)])})

    none = F.lit(None).cast("double")
    return blocks.withColumn("_f", found("a", "b")).select(*blocks.columns, "_f.u", "_f.v", none.alias("pkr"), none.alias("snr"))


Matcher = Callable[[np.ndarray, np.ndarray], tuple]


def match_by(blocks: DataFrame, size: int, func: Matcher) -> DataFrame:
    """Adds u, v, pkr, snr from func(block1, block2) -> (dx, dy, pkr, snr)."""
    @F.pandas_udf("u double, v double, pkr double, snr double")
    def applied(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        got = [func(x, y) for x, y in zip(_images(a, size), _images(b, size), strict=True)]
        return pd.DataFrame([(-x[0], -x[1], x[2], x[3]) for x in got], columns=["u", "v", "pkr", "snr"], dtype="Float64")

    return blocks.withColumn("_f", applied("a", "b")).select(*blocks.columns, "_f.*")


def matched(blocks: DataFrame, size: int, by: str | Matcher = "ncc", subpixel: str = "parabolic") -> DataFrame:
    """Matches blocks by the method named (ncc, pcc, upsampled, flow) or by a function of two blocks."""
    if callable(by):
        return match_by(blocks, size, by)
    if by in ("ncc", "pcc"):
        return (match_ncc if by == "ncc" else match_pcc)(blocks, size, subpixel)
    if by == "upsampled":
        return match_upsampled(blocks, size)
    if by == "flow":
        return flow.match_flow(blocks, size)
    raise ValueError(f"no such match: {by}")


def track(stack: DataFrame, pairs: DataFrame, shape: tuple[int, int], method: str = "block_matching", block: int = 16, overlap: float = 0.8, by: str | Matcher = "ncc", subpixel: str = "parabolic", filters: dict | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Displacements of all pairs (pair_id, idx1, idx2) of scenes of a stack (scene, y, x, v): pair_id, pt_idx,
    x, y, u, v, pkr, snr.  `method`: block_matching, or optical_flow for every pixel.  `filters`: what
    filter_pairs takes, or a function from DataFrame to DataFrame.  Pairs whose scenes aren't in the stack
    give no rows.

    Filters read what is matched twice, for a pair's statistics and for its rows: where matching is dear, store
    it first (sources.files.predictions) and filter what is stored."""
    if method == "block_matching":
        step, (height, width) = stride(block, overlap), shape
        blocks = pair_blocks(cut_blocks(stack, block, step, height, width), pairs, (width - block) // step + 1)
        rows = matched(blocks, block, by, subpixel)
    elif method == "optical_flow":
        rows = flow.dense_flow(stack, pairs, shape)
    else:
        raise ValueError(f"no such method: {method}")
    rows = rows.select("pair_id", "pt_idx", "x", "y", *[F.col(c).cast("double").alias(c) for c in ("u", "v", "pkr", "snr")])
    if filters is None:
        return rows
    return filters(rows) if callable(filters) else filter_pairs(rows, **filters)


def cut_blocks(pixels: DataFrame, size: int, step: int, height: int, width: int) -> DataFrame:
    """scene, by, bx, x, y (the middle) and data, row by row, of all blocks that fit."""
    rows, cols = (height - size) // step + 1, (width - size) // step + 1
    first = lambda c: F.greatest(F.ceil((F.col(c) - size + 1) / step), F.lit(0)).cast("int")
    last = lambda c, n: F.least(F.floor(F.col(c) / step), F.lit(n - 1)).cast("int")
    p = pixels.where((first("y") <= last("y", rows)) & (first("x") <= last("x", cols)))
    p = p.withColumn("by", F.explode(F.sequence(first("y"), last("y", rows)))).withColumn("bx", F.explode(F.sequence(first("x"), last("x", cols))))
    data = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"])
    return p.groupBy("scene", "by", "bx").agg(data.alias("data")).withColumns({"y": F.col("by") * step + size // 2, "x": F.col("bx") * step + size // 2})


def pair_blocks(cut: DataFrame, pairs: DataFrame, columns: int) -> DataFrame:
    """pair_id, pt_idx (the block's place, row by row, of `columns` blocks a row), x, y, a, b: the blocks of both
    scenes (idx1, idx2) of every pair."""
    a = cut.select(F.col("scene").alias("idx1"), "by", "bx", "x", "y", F.col("data").alias("a"))
    b = cut.select(F.col("scene").alias("idx2"), "by", "bx", F.col("data").alias("b"))
    both = pairs.select("pair_id", "idx1", "idx2").join(a, "idx1").join(b, ["idx2", "by", "bx"])
    return both.select("pair_id", (F.col("by") * columns + F.col("bx")).alias("pt_idx"), "x", "y", "a", "b")
