"""Live scoring: a static background, a stream of frames, and a bounded buffer for each camera."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def score_stream(stream: DataFrame, background: DataFrame, keys: list[str], feature: str, dim: int, detector: str = "frx_bayes") -> DataFrame:
    """The stream with the detector's score; the background is a static table, joined to each micro-batch."""
    from ..operators.background import detectors

    return detectors(stream, background, keys, feature, dim).drop(*({"rem", "frx_global", "frx_cell", "frx_bayes"} - {detector})).withColumnRenamed(detector, "score")


def causal_alarms(stream: DataFrame, key: str, time: str, row_id: str, score: str, threshold: float, width: int = 9, warm_up: int = 1) -> DataFrame:
    """key, row_id, time, score, smoothed, alarm: median of a camera's last `width` scores, against the threshold.

    State is the last width - 1 scores of a camera and the count of its rows. Rows of a micro-batch are taken in order of
    (time, row_id); a row that comes in a later micro-batch than its successors is taken as it comes, like a late frame.
    Nothing is emitted before the camera's warm_up-th row. Works on a batch frame's stream alike.
    """
    kinds = dict(stream.dtypes)
    out = f"{key} {kinds[key]}, {row_id} {kinds[row_id]}, {time} {kinds[time]}, {score} double, smoothed double, alarm boolean"

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = state.get if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values([time, row_id], kind="stable")
        own = rows[score].to_numpy(np.float64)
        whole = np.concatenate([np.asarray(last, np.float64), own])
        smoothed = [float(np.median(whole[max(0, i - width + 1) : i + 1])) for i in range(len(whole) - len(own), len(whole))]
        state.update((seen + len(own), whole[-(width - 1) :].tolist() if width > 1 else []))
        result = rows[[key, row_id, time, score]].assign(smoothed=smoothed)
        result["alarm"] = result["smoothed"] > threshold
        yield result.iloc[max(0, warm_up - 1 - seen) :]

    return stream.select(key, row_id, time, score).groupBy(key).applyInPandasWithState(step, out, "seen long, last array<double>", "append", GroupStateTimeout.NoTimeout)


def deduplicated(stream: DataFrame, row_id: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """Rows once each, as long as repeats come within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([row_id])


def alarm_rates(alarms: DataFrame, time: str, width: str = "1 day", delay: str | None = "10 minutes") -> DataFrame:
    """window start, frames, alarms for tumbling windows of event time. No delay: the stream has a watermark already."""
    return (alarms.withWatermark(time, delay) if delay else alarms).groupBy(F.window(time, width)).agg(F.count("*").alias("frames"), F.sum(F.col("alarm").cast("long")).alias("alarms")).select(F.col("window.start").alias("start"), "frames", "alarms")


def calibrated_threshold(scores: DataFrame, key: str, time: str, row_id: str, score: str, quantile: float = 0.995, width: int = 9, every: int = 2) -> float:
    """The quantile of normal rows' smoothed scores: every second row of a camera, so a median of half the width is causal over as long."""
    from ..operators.ranking import quantile as exact
    from ..operators.temporal import causal_median

    turn = F.row_number().over(Window.partitionBy(key).orderBy(time, row_id)) - 1
    rows = scores.withColumn("_turn", turn).where(F.col("_turn") % every == 0)
    found = exact(causal_median(rows, [key], "_turn", score, "_smoothed", width=max(1, width // every)), [], "_smoothed", quantile, "_cut").first()
    return float(found[0]) if found and found[0] is not None else float("inf")
