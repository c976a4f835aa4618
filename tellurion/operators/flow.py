"""Dense optical flow between two images, by polynomial expansion over a pyramid (Farnebäck, 2003).

Each pixel's neighbourhood is approximated by a quadratic, by least squares under a Gaussian weight.  A shift d
between two images changes the linear part by -2 A d; d is found for averages over a window, from coarse to fine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _along(image: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with a kernel along one axis, the edge repeated."""
    half = len(kernel) // 2
    padded = np.pad(image, [(half, half) if k == axis else (0, 0) for k in range(image.ndim)], mode="edge")
    n = image.shape[axis]
    return sum(w * np.take(padded, np.arange(k, k + n), axis=axis) for k, w in enumerate(kernel))


def expansion(image: np.ndarray, size: int, sigma: float) -> np.ndarray:
    """Of each pixel the coefficients of 1, x, y, x^2, y^2, xy."""
    t = np.arange(-(size // 2), size // 2 + 1, dtype=float)
    weight = np.exp(-t * t / (2 * sigma * sigma))
    weight /= weight.sum()
    y, x = np.meshgrid(t, t, indexing="ij")
    basis = np.stack([np.ones_like(x), x, y, x * x, y * y, x * y]).reshape(6, -1)
    gram = (basis * np.outer(weight, weight).ravel()) @ basis.T
    powers = [(0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)]
    moments = np.stack([_along(_along(image, weight * t**p, 1), weight * t**q, 0) for p, q in powers])
    return np.tensordot(np.linalg.inv(gram), moments, axes=1)


def _sampled(field: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values of the last two axes at places, held to the image."""
    h, w = field.shape[-2:]
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    fy, fx = y - y0, x - x0
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    return field[..., y0, x0] * (1 - fy) * (1 - fx) + field[..., y0, x1] * (1 - fy) * fx + field[..., y1, x0] * fy * (1 - fx) + field[..., y1, x1] * fy * fx


def _resized(image: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    (h, w), (a, b) = image.shape[-2:], shape
    y, x = np.meshgrid((np.arange(a) + 0.5) * h / a - 0.5, (np.arange(b) + 0.5) * w / b - 0.5, indexing="ij")
    return _sampled(image, y, x)


def flow_between(first: np.ndarray, second: np.ndarray, levels: int = 5, window: int = 15, steps: int = 3, size: int = 5, sigma: float = 1.2, gaussian: bool = True) -> np.ndarray:
    """(dx, dy) of each pixel of `first`: where it is in `second`.  Levels below 16 pixels are left out."""
    shape, found = first.shape, None
    if gaussian:
        t = np.arange(window) - window // 2
        kernel = np.exp(-t * t / (2 * (0.15 * window) ** 2 + 1e-12))
    else:
        kernel = np.ones(window)
    kernel = kernel / kernel.sum()
    for level in range(levels - 1, -1, -1):
        scale = 0.5**level
        small = max(1, round(shape[0] * scale)), max(1, round(shape[1] * scale))
        if level and min(small) < 16:
            continue
        images = []
        for image in (first, second):
            image = image.astype(float)
            if level:
                r = (1 / scale - 1) / 2
                t = np.arange(-int(3 * r + 1), int(3 * r + 1) + 1)
                blur = np.exp(-t * t / (2 * r * r))
                image = _resized(_along(_along(image, blur / blur.sum(), 0), blur / blur.sum(), 1), small)
            images.append(expansion(image, size, sigma))
        before, after = images
        y, x = np.meshgrid(np.arange(small[0]), np.arange(small[1]), indexing="ij")
        d = np.zeros((2, *small)) if found is None else _resized(found[0], small) * scale / found[1]
        for _ in range(steps):
            there = _sampled(after, y + d[1], x + d[0])
            a11, a22, a12 = (before[3] + there[3]) / 2, (before[4] + there[4]) / 2, (before[5] + there[5]) / 4
            b1 = (before[1] - there[1]) / 2 + a11 * d[0] + a12 * d[1]
            b2 = (before[2] - there[2]) / 2 + a12 * d[0] + a22 * d[1]
            parts = np.stack([a11 * a11 + a12 * a12, a12 * (a11 + a22), a22 * a22 + a12 * a12, a11 * b1 + a12 * b2, a12 * b1 + a22 * b2])
            g11, g12, g22, h1, h2 = _along(_along(parts, kernel, 1), kernel, 2)
            det = g11 * g22 - g12 * g12 + 1e-3 * 1e-6
            d = np.stack([(g22 * h1 - g12 * h2) / det, (g11 * h2 - g12 * h1) / det])
        found = d, scale
    return found[0]


def match_flow(blocks: DataFrame, size: int) -> DataFrame:
    """Adds u and v: the median flow of each pair of blocks; no pkr or snr."""
    @F.pandas_udf("u double, v double")
    def median(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        flows = [flow_between(np.reshape(x, (size, size)), np.reshape(y, (size, size)), levels=3, window=size, gaussian=False) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame([tuple(np.median(d, axis=(1, 2))) for d in flows], columns=["u", "v"], dtype=float)

    none = F.lit(None).cast("double")
    return blocks.withColumn("_f", median("a", "b")).select(*blocks.columns, "_f.u", "_f.v", none.alias("pkr"), none.alias("snr"))


def dense_flow(stack: DataFrame, pairs: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """pair_id, pt_idx, x, y, u, v of every pixel of every pair; no pkr or snr.  A task holds the two images of
    one pair: the flow of a pixel depends on all of both."""
    height, width = shape

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        images = np.zeros((2, height, width))
        images[pdf["side"], pdf["y"], pdf["x"]] = pdf["v"].fillna(0.0)
        d = flow_between(*images)
        y, x = np.indices((height, width)).reshape(2, -1)
        return pd.DataFrame({"pair_id": pdf["pair_id"].iloc[0], "pt_idx": np.arange(height * width), "x": x, "y": y, "u": d[0].ravel(), "v": d[1].ravel()})

    sides = pairs.select("pair_id", F.posexplode(F.array("idx1", "idx2")).alias("side", "scene"))
    whole = pairs.select("pair_id", "idx1", "idx2").join(stack.select(F.col("scene").alias("idx1")).distinct(), "idx1", "left_semi").join(stack.select(F.col("scene").alias("idx2")).distinct(), "idx2", "left_semi")
    rows = sides.join(whole.select("pair_id"), "pair_id", "left_semi").join(stack.select("scene", "y", "x", "v"), "scene")
    got = rows.groupBy("pair_id").applyInPandas(found, "pair_id long, pt_idx int, x int, y int, u double, v double")
    return got.withColumns({c: F.lit(None).cast("double") for c in ("pkr", "snr")})
