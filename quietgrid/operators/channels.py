"""Channels of motion: scores of cells' flow features under three backgrounds, and of whole frames from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import background as B
from . import grid as G
from . import mixture as X
from .motion import speed
from .sampling import cap
from .skew import skewed_fits, skewed_scores

FLOW_UBM, FLOW_RX, FLOW_ST = "flow_ubm", "flow_rx", "flow_st"


def flow_channels(features: DataFrame, normal: DataFrame, frames: list[str], bins: int = 8, components: int = X.COMPONENTS, rounds: int | None = None, seed: int = 0) -> DataFrame:
    """features (frames, cell_id, f of bins + 1 numbers) with flow_ubm, flow_rx and flow_st.

    normal: the features of normal frames, which alone are learned from. flow_ubm is the negative log density of the cell's
    speed under the universal mixture adapted to it, flow_rx the distance of the whole feature from its cell's shrunk
    background, flow_st its negative log density under the cell's skewed t. Cells without normal frames have no rows.
    """
    dim = bins + 1
    slow = lambda d: d.withColumn("_speed", speed(F.col("f"), bins))
    learned = slow(normal)
    ubm = X.Mixture.fit(cap(learned, [*frames, "cell_id"], X.ROWS, seed), "_speed", components, seed)
    rows = X.score(slow(features), X.adapt(learned, "cell_id", "_speed", ubm), "cell_id", "_speed", ubm, FLOW_UBM).drop("_speed")
    background = B.finalise(B.moments(normal, ["cell_id"], "f", dim), ["cell_id"], dim)
    rows = B.detectors(rows, background, ["cell_id"], "f", dim).withColumnRenamed("frx_bayes", FLOW_RX).drop("rem", "frx_global", "frx_cell")
    found = skewed_fits(normal, "cell_id", "f", [*frames, "cell_id"], **({} if rounds is None else {"rounds": rounds}))
    return skewed_scores(rows, found, "cell_id", "f", FLOW_ST)


def frame_channels(cells: DataFrame, frames: list[str], channels: list[str], height: int, width: int, cell: int, pool: int) -> DataFrame:
    """frames, channel, score: of each channel of cells (frames, cell_id and a column for each) the largest local mean of its map."""
    tall, wide = -(-height // cell), -(-width // cell)
    long = cells.select(*frames, "cell_id", F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in channels))).alias("c")).select(*frames, "cell_id", "c.channel", "c.v")
    maps = G.upsample(long, [*frames, "channel"], "v", tall, wide, height, width)
    return G.frame_score(maps, [*frames, "channel"], "v", height, width, pool)
