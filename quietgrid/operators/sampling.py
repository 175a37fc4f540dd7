"""Picking rows: strides, caps by hash, top-k batches, starts of clips, evenly spread frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stride(df: DataFrame, time: str, first: int, step: int) -> DataFrame:
    """Rows first, first + step, ... of each series. A plain predicate, so it is pushed below models and into scans."""
    return df.where((F.col(time) >= first) & ((F.col(time) - first) % step == 0))


def _drawn(ids: list[str], seed: int):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(i).cast("string") for i in ids)))


def cap(df: DataFrame, ids: list[str], n: int, seed: int = 0, keys: list[str] | None = None) -> DataFrame:
    """n rows at most (of each group, given keys), those first by a hash of seed and ids: the same on every run."""
    order = [_drawn(ids, seed), *ids]
    if keys:
        return df.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_turn") <= n).drop("_turn")
    drawn = df.withColumn("_draw", order[0])
    return _thinned(df, drawn, n).orderBy("_draw", *ids).limit(n).drop("_draw")


def _thinned(df: DataFrame, drawn: DataFrame, n: int) -> DataFrame:
    """Rows of drawn under a threshold of the hash that leaves somewhat over n, so that each task sends few to the last sort."""
    share = (1.25 * n + 1000) / max(1, df.count())
    if share >= 1:
        return drawn
    few = drawn.where(F.conv(F.substring("_draw", 1, 8), 16, 10).cast("long") < int(share * (1 << 32)))
    return few if few.limit(n).count() == n else drawn  # ids that very many rows share may all lie above


def first_frames(df: DataFrame, keys: list[str], time: str, n: int) -> DataFrame:
    """The first n rows of each series in time. Ranks are cut off in each task before the shuffle, so a long series sends n rows from each."""
    return df.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(time))).where(F.col("_turn") <= n).drop("_turn")


def clip_starts(df: DataFrame, keys: list[str], time: str, length: int, step: int) -> DataFrame:
    """Rows at which a whole clip can end; series too short for one have none."""
    return df.where(F.col(time) >= (length - 1) * step)


def motion_batch(df: DataFrame, ids: list[str], motion: str, size: int, share: float, seed: int = 0) -> DataFrame:
    """A batch of `size` out of 2 * size candidates: int(size * share) with most motion, the others drawn from the rest."""
    candidates = cap(df, ids, 2 * size, seed)
    top = candidates.orderBy(F.desc(motion), *ids).limit(int(size * share))
    rest = cap(candidates.join(top.select(*ids), ids, "left_anti"), ids, size - int(size * share), seed + 1)
    return top.withColumn("pick", F.lit("motion")).unionByName(rest.withColumn("pick", F.lit("random")))


def dimensions(df: DataFrame, feature: str, indices: list[int], out: str) -> DataFrame:
    """The named components of a vector."""
    return df.withColumn(out, F.transform(F.array(*map(F.lit, indices)), lambda i: F.element_at(F.col(feature), i + 1)))


def spread(df: DataFrame, video: str, time: str, k: int, step: int = 7919) -> DataFrame:
    """k rows spread over videos: pick i is of the (i mod V)-th video its frame (i * step) mod N. Videos are few beside frames."""
    videos = df.groupBy(video).agg(F.count("*").alias("_n"))
    numbered = videos.withColumn("_v", F.row_number().over(Window.orderBy(video)) - 1)
    total = numbered.agg(F.count("*").alias("_videos"))  # one row
    picks = df.sparkSession.range(k).withColumnRenamed("id", "pick").crossJoin(F.broadcast(total)).withColumn("_v", (F.col("pick") % F.col("_videos")).cast("int")).drop("_videos")
    wanted = picks.join(numbered, "_v").withColumn(time, ((F.col("pick") * step) % F.col("_n")).cast("int")).select("pick", video, time)
    return wanted.join(df, [video, time])
