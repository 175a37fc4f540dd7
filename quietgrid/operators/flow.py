"""Dense sub-pixel displacement between frames by polynomial expansion, over a pyramid of coarser frames.

Around every pixel a frame is fitted by a quadratic under Gaussian weights. A quadratic that moves keeps its second-order part,
and its first-order part changes by twice that part times the displacement; the equations of a neighbourhood, weighed again,
give the displacement. It begins on the coarsest level and is corrected on each finer one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .motion import cells_of

#: Deviation of the weights of a fit and of a neighbourhood; levels at most and the least side of the coarsest; corrections on each level.
FIT, AROUND, LEVELS, SIDE, ROUNDS = 1.5, 3.0, 4, 16, 5


@lru_cache
def _gaussian(sigma: float) -> np.ndarray:
    reach = max(1, round(3 * sigma))
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return w / w.sum()


def _along(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with a kernel along an axis; the border repeats."""
    reach = len(kernel) // 2
    wide = [(0, 0)] * a.ndim
    wide[axis] = (reach, reach)
    padded, n = np.pad(a, wide, mode="edge"), a.shape[axis]
    out = np.zeros_like(a)
    for k, w in enumerate(kernel):
        out += w * np.take(padded, range(k, k + n), axis)
    return out


def expansion(frame: np.ndarray, sigma: float = FIT) -> np.ndarray:
    """(H, W, 5): of the quadratic around each pixel the terms of x, y, x^2, y^2 and xy."""
    w = _gaussian(sigma)
    t = np.arange(len(w)) - len(w) // 2
    down = [_along(frame, w * t**k, 0) for k in range(3)]
    sums = np.stack([_along(down[j], w * t**i, 1) for i, j in ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1))], -1)
    return sums @ _inverse(sigma)[1:].T


@lru_cache
def _inverse(sigma: float) -> np.ndarray:
    """Inverse of the weighted products of 1, x, y, x^2, y^2 and xy."""
    w = _gaussian(sigma)
    t = np.arange(len(w)) - len(w) // 2
    y, x = np.meshgrid(t, t, indexing="ij")
    basis = np.stack([np.ones_like(x), x, y, x * x, y * y, x * y], -1).reshape(-1, 6).astype(np.float64)
    return np.linalg.inv(basis.T @ (np.outer(w, w).reshape(-1, 1) * basis))


def sampled(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a at fractional positions, linear between pixels; beyond the border it repeats."""
    h, w = a.shape[:2]
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    top, left = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    below, right = np.minimum(top + 1, h - 1), np.minimum(left + 1, w - 1)
    fy, fx = ((v).reshape(v.shape + (1,) * (a.ndim - 2)) for v in (y - top, x - left))
    return (1 - fy) * ((1 - fx) * a[top, left] + fx * a[top, right]) + fy * ((1 - fx) * a[below, left] + fx * a[below, right])


def _corrected(one: np.ndarray, two: np.ndarray, d: np.ndarray, sigma: float) -> np.ndarray:
    """A better displacement (H, W, 2) from the expansions of two frames and a first one."""
    y, x = np.indices(d.shape[:2])
    moved = sampled(two, y + d[..., 1], x + d[..., 0])
    mean = (one + moved) / 2
    a, b, c = mean[..., 2], mean[..., 4] / 2, mean[..., 3]  # of the symmetric matrix of second-order terms
    gx = (one[..., 0] - moved[..., 0]) / 2 + a * d[..., 0] + b * d[..., 1]
    gy = (one[..., 1] - moved[..., 1]) / 2 + b * d[..., 0] + c * d[..., 1]
    w = _gaussian(sigma)
    near = _along(_along(np.stack([a * a + b * b, b * (a + c), b * b + c * c, a * gx + b * gy, b * gx + c * gy], -1), w, 0), w, 1)
    m11, m12, m22, h1, h2 = np.moveaxis(near, -1, 0)
    ridge = 1e-6 * (m11 + m22).max() + 1e-12
    m11, m22 = m11 + ridge, m22 + ridge
    det = m11 * m22 - m12 * m12
    return np.stack([(m22 * h1 - m12 * h2) / det, (m11 * h2 - m12 * h1) / det], -1)


def dense_flow(old: np.ndarray, new: np.ndarray, levels: int = LEVELS, rounds: int = ROUNDS, fit: float = FIT, around: float = AROUND) -> np.ndarray:
    """(H, W, 2): dx, dy by which each pixel of the old frame moves to the new one. Where a frame has no structure it is near 0."""
    pyramid = [(old.astype(np.float64), new.astype(np.float64))]
    while len(pyramid) < levels and min(pyramid[-1][0].shape) >= 2 * SIDE:
        w = _gaussian(1.0)
        pyramid.append(tuple(_along(_along(f, w, 0), w, 1)[::2, ::2] for f in pyramid[-1]))
    d = np.zeros((*pyramid[-1][0].shape, 2))
    for k, (a, b) in enumerate(reversed(pyramid)):
        if k:
            y, x = np.indices(a.shape)
            d = 2 * sampled(d, y / 2, x / 2)
        one, two = expansion(a, fit), expansion(b, fit)
        for _ in range(rounds):
            d = _corrected(one, two, d, around)
    return d


def _pairs(frames: DataFrame, keys: list[str], time: str, gap: int) -> DataFrame:
    before = F.lag("px", gap).over(Window.partitionBy(*keys).orderBy(time))
    return frames.withColumn("_before", before).where("_before is not null").select(*keys, time, "h", "w", "px", F.col("_before").alias("before"))


def _flows(batch: pd.DataFrame, options: dict) -> Iterator[tuple[tuple, np.ndarray]]:
    for row in batch.itertuples(index=False):
        now, old = (np.frombuffer(b, np.uint8).reshape(row.h, row.w) for b in (row.px, row.before))
        yield row, dense_flow(old, now, **options)


def optical_flow(frames: DataFrame, keys: list[str], time: str, gap: int = 1, **options) -> DataFrame:
    """keys, time, y, x, dx, dy: of each pixel of the frame `gap` before, where it has moved to. Frames without one have no rows.

    frames: keys, time, h, w, px (bytes). A pair of frames is a row, so a task holds a batch of pairs, never a video.
    """
    kinds = dict(frames.dtypes)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, d in _flows(batch, options):
                y, x = np.indices(d.shape[:2])
                yield pd.DataFrame({k: getattr(row, k) for k in [*keys, time]} | {"y": y.ravel(), "x": x.ravel(), "dx": d[..., 0].ravel(), "dy": d[..., 1].ravel()})

    return _pairs(frames, keys, time, gap).mapInPandas(task, ", ".join(f"{k} {kinds[k]}" for k in [*keys, time]) + ", y int, x int, dx double, dy double")


def dense_flow_features(frames: DataFrame, keys: list[str], time: str, cell: int = 8, bins: int = 8, gap: int = 1, **options) -> DataFrame:
    """keys, time, cell_id, f: flow_features() of optical_flow(), made where the flow is, so that no row for each pixel leaves a task.

    The first `gap` frames of a series take over the features of the first frame that has a flow; a series without one has zeros.
    """
    kinds = dict(frames.dtypes)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, d in _flows(batch, options):
                f = cells_of(d, cell, bins)
                yield pd.DataFrame({k: getattr(row, k) for k in [*keys, time]} | {"cell_id": np.arange(len(f)), "f": list(f)})

    found = _pairs(frames, keys, time, gap).mapInPandas(task, ", ".join(f"{k} {kinds[k]}" for k in [*keys, time]) + ", cell_id int, f array<double>")
    grid = F.ceil(F.col("h") / cell) * F.ceil(F.col("w") / cell)
    cells = frames.select(*keys, time, F.explode(F.sequence(F.lit(0), (grid - 1).cast("int"))).alias("cell_id"))
    rows = cells.join(found, [*keys, time, "cell_id"], "left")
    ahead = Window.partitionBy(*keys, "cell_id").orderBy(time).rowsBetween(0, gap)
    return rows.withColumn("f", F.coalesce("f", F.first("f", ignorenulls=True).over(ahead), F.array_repeat(F.lit(0.0), bins + 1)))
