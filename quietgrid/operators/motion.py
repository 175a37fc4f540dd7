"""Motion features of cells from displacements of pixels (rows of frame keys, y, x, dx, dy).

Displacements come from outside, from flow.optical_flow(), or from block_matching() by whole pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import direction_bin, magnitude
from .grid import cell_id


def flow_features(flow: DataFrame, frames: list[str], cell: int, width: int, bins: int = 8) -> DataFrame:
    """frames, cell_id, f: ln(1 + v) of a cell's mean magnitude in each direction bin (over its full area), and of its largest."""
    rows = flow.withColumn("_m", magnitude(F.col("dx"), F.col("dy"))).withColumn("_b", direction_bin(F.col("dx"), F.col("dy"), bins))
    sums = [F.log1p(F.sum(F.when(F.col("_b") == k, F.col("_m")).otherwise(0.0)) / (cell * cell)) for k in range(bins)]
    return rows.groupBy(*frames, cell_id(F.col("y"), F.col("x"), cell, width).alias("cell_id")).agg(F.array(*sums, F.log1p(F.max("_m"))).alias("f"))


def cells_of(d: np.ndarray, cell: int, bins: int = 8) -> np.ndarray:
    """flow_features() of one frame's displacements (H, W, 2), as (cells, bins + 1)."""
    h, w = d.shape[:2]
    m, a = np.hypot(d[..., 0], d[..., 1]), np.arctan2(d[..., 1], d[..., 0])
    b = np.minimum((np.where(a < 0, a + 2 * np.pi, a) / (2 * np.pi) * bins).astype(int), bins - 1)
    y, x = np.indices((h, w))
    wide = -(-w // cell)
    own = y // cell * wide + x // cell
    cells = -(-h // cell) * wide
    sums = np.bincount((own * bins + b).ravel(), m.ravel(), cells * bins).reshape(cells, bins) / (cell * cell)
    most = np.zeros(cells)
    np.maximum.at(most, own.ravel(), m.ravel())
    return np.log1p(np.concatenate([sums, most[:, None]], 1))


def speed(f: Column, bins: int = 8) -> Column:
    """(ln(1 + mean magnitude), ln(1 + largest magnitude)) of a feature of flow_features()."""
    whole = F.aggregate(F.slice(f, 1, bins), F.lit(0.0), lambda s, x: s + F.expm1(x))
    return F.array(F.log1p(whole), F.element_at(f, bins + 1))


def block_matching(frames: DataFrame, keys: list[str], time: str, block: int = 8, reach: int = 3, gap: int = 1) -> DataFrame:
    """keys, time, y, x, dx, dy: of each block of a frame the whole-pixel shift from `gap` frames before that fits best.

    frames: keys, time, h, w, px (bytes). Frames without a predecessor have no rows. Ties go to the smaller shift. Pairs of
    frames are rows, so tasks are as small as a pair and nothing of a video is gathered.
    """
    pairs = frames.withColumn("_before", F.lag("px", gap).over(Window.partitionBy(*keys).orderBy(time))).where("_before is not null")
    shifts = sorted(((dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)), key=lambda s: (s[0] ** 2 + s[1] ** 2, s))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                h, w = row.h, row.w
                now, old = (np.frombuffer(b, np.uint8).reshape(h, w).astype(np.int32) for b in (row.px, row.before))
                padded = np.pad(old, reach, mode="edge")
                cost = np.stack([np.add.reduceat(np.add.reduceat(np.abs(now - padded[reach - dy : reach - dy + h, reach - dx : reach - dx + w]), np.arange(0, h, block), 0), np.arange(0, w, block), 1) for dy, dx in shifts])
                best = cost.argmin(0)
                y, x = np.indices(best.shape)
                out = {k: getattr(row, k) for k in [*keys, time]} | {"y": y.ravel() * block, "x": x.ravel() * block, "dx": [float(shifts[i][1]) for i in best.ravel()], "dy": [float(shifts[i][0]) for i in best.ravel()]}
                yield pd.DataFrame(out)

    kinds = dict(frames.dtypes)
    return pairs.select(*keys, time, "h", "w", "px", F.col("_before").alias("before")).mapInPandas(match, ", ".join(f"{k} {kinds[k]}" for k in [*keys, time]) + ", y int, x int, dx double, dy double")
