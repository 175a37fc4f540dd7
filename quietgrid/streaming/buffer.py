"""Clips of a live stream: for each camera a ring of its last frames in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that list state needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ring(StatefulProcessor):
    """Keeps the last (length - 1) * step frames of a camera; a frame that completes a clip is emitted with it."""

    def __init__(self, key: str, row_id: str, time: str, value: str, out: str, kind: str, length: int, step: int):
        self.names, self.kind, self.length, self.step = (key, row_id, time, value, out), kind, length, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", f"v {self.kind}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        camera, row_id, time, value, out = self.names
        span = (self.length - 1) * self.step
        own = pd.concat(list(rows)).sort_values([time, row_id], kind="stable")
        plain = lambda v: [plain(x) for x in v] if hasattr(v, "__len__") and not isinstance(v, (str, bytes)) else v
        held = [plain(v[0]) for v in self.ring.get()] if self.ring.exists() else []
        whole = held + [plain(v) for v in own[value]]
        if span and whole[-span:]:
            self.ring.put([(v,) for v in whole[-span:]])
        first = max(0, span - len(held))  # of these rows, the first that completes a clip
        clips = [whole[at - span : at + 1 : self.step] for at in range(len(held) + first, len(whole))]
        result = own[[camera, row_id, time]].iloc[first:].assign(**{out: clips})
        if len(result):
            yield result

    def close(self) -> None:
        pass


def live_clips(stream: DataFrame, key: str, row_id: str, time: str, value: str, out: str = "clip", length: int = 4, step: int = 2) -> DataFrame:
    """key, row_id, time, out: the last `length` values of a camera, `step` apart, ending at the row.

    Nothing is emitted before a camera's first whole clip. value is a number or a vector. Rows of a micro-batch are taken in
    order of (time, row_id); a row that comes in a later micro-batch than its successors is taken as it comes. State is
    (length - 1) * step values a camera, in RocksDB, so it outlives restarts and needn't fit in memory.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = dict(stream.dtypes)
    schema = f"{key} {kinds[key]}, {row_id} {kinds[row_id]}, {time} {kinds[time]}, {out} array<{kinds[value]}>"
    ring = _Ring(key, row_id, time, value, out, kinds[value], length, step)
    return stream.select(key, row_id, time, value).groupBy(key).transformWithStateInPandas(ring, schema, "append", "none")
