"""Calibration of channel scores against normal reference scores, and their fusion.

Frames are long: keys (such as channel), and a score. References have the same keys and column.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .lookup import joined, lookup, measured
from .ranking import picked_quantile, reference_counts, totals_below, value_counts
from .ranking import quantile as exact_quantile

#: Fixed values of the tail: its quantile, the least scale of excesses.
TAIL, LEAST_SCALE = 0.9, 1e-6
#: Pseudo-counts of the scene-wide survival function in a cell's.
KAPPA = 20.0


def folds(df: DataFrame, scene: list[str], video: str, out: str = "fold", n: int = 2) -> DataFrame:
    """df and the fold of its video: the position of the video's name in its scene, modulo n. Videos are few beside frames."""
    names = df.select(*scene, video).distinct()
    order = Window.partitionBy(*scene).orderBy(video) if scene else Window.orderBy(video)
    return df.join(names.withColumn(out, ((F.row_number().over(order) - 1) % n).cast("int")), [*scene, video])


def z_scores(scores: DataFrame, reference: DataFrame, keys: list[str], score: str, out: str = "z") -> DataFrame:
    """(score - mean) / population standard deviation (plus 1e-12) of the reference."""
    fit = reference.groupBy(*keys).agg(F.avg(score).alias("_m"), (F.stddev_pop(score) + 1e-12).alias("_sd"))
    return lookup(scores, fit, keys).withColumn(out, (F.col(score) - F.col("_m")) / F.col("_sd")).drop("_m", "_sd")


def tail_evidence(scores: DataFrame, reference: DataFrame, keys: list[str], score: str, out: str = "evidence") -> DataFrame:
    """-log of the upper-tail probability of a score under the reference: exponential above its 0.9 quantile, else empirical."""
    # one table of counts, kept, gives sizes, quantiles, excesses and ranks
    counts = checkpointed(reference_counts(scores, reference, keys, score))
    sizes = counts.groupBy(*keys).agg(F.sum("_ref").alias("_n")).where("_n > 0")
    cut = picked_quantile(counts, sizes, keys, score, "_ref", TAIL, "_u").join(sizes, keys)
    over = counts.join(cut.select(*keys, "_u"), keys).where(F.col(score) > F.col("_u")).groupBy(*keys).agg((F.sum(F.col("_ref") * (F.col(score) - F.col("_u"))) / F.nullif(F.sum("_ref"), F.lit(0))).alias("_beta"))
    fit = cut.join(over, keys, "left").withColumn("_beta", F.greatest(F.coalesce("_beta", F.lit(LEAST_SCALE)), F.lit(LEAST_SCALE)))
    # few values, each on many rows, are a small table, which is broadcast; with many values rows are joined by value
    ranked = joined(scores, counts.select(*keys, score, F.col("below__ref").alias("_below")), [*keys, score], measured(counts), salts=1)
    ranked = lookup(ranked, fit, keys)
    empirical = -F.ln((F.col("_n") - F.col("_below") + 1) / (F.col("_n") + 1))
    tail = -math.log(1 - TAIL) + (F.col(score) - F.col("_u")) / F.col("_beta")
    return ranked.withColumn(out, F.when(F.col(score) > F.col("_u"), tail).otherwise(empirical)).drop("_u", "_n", "_beta", "_below")


def fuse(evidence: DataFrame, keys: list[str], channel: str, value: str, out: str = "fused", channels: list[str] | None = None) -> DataFrame:
    """Sum over channels. Frames that lack one of the named channels are left out."""
    rows = evidence.where(F.col(channel).isin(channels)) if channels else evidence
    summed = rows.groupBy(*keys).agg(F.sum(value).alias(out), F.count_distinct(channel).alias("_channels"))
    return (summed.where(F.col("_channels") == len(channels)) if channels else summed).drop("_channels")


def cross_fitted(
    df: DataFrame, scene: list[str], video: str, time: str, fit: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame, DataFrame], DataFrame], every: int = 3, n: int = 2
) -> tuple[DataFrame, DataFrame]:
    """(the model of all of df, held-out scores of every `every`-th frame of it): how a channel is fitted and scaled.

    df: frames of normal videos. Videos are dealt to n folds; fit takes the frames of the other folds, score takes those held
    out and that model, and the scores are a reference no model of which has seen its own frames. A fold whose others have no
    frames has no scores: one video alone gives a model and an empty reference.
    """
    dealt = folds(df, scene, video, "_fold", n)
    held = None
    for k in range(n):
        own = dealt.where(F.col("_fold") == k).where(F.col(time) % every == 0).drop("_fold")
        scored = score(own, fit(dealt.where(F.col("_fold") != k).drop("_fold")))
        held = scored if held is None else held.unionByName(scored)
    return fit(df), held


def fuse_z(scores: DataFrame, reference: DataFrame, keys: list[str], channel: str, score: str, sums: dict[str, list[str]], out: str = "fused") -> DataFrame:
    """keys, name, out: sums of z-scores over the named sets of channels, scales from the reference.

    A set with a channel that has no reference is skipped as a whole; so is, of a set, a frame that lacks one of its channels.
    """
    spark = scores.sparkSession
    table = spark.createDataFrame([(name, c, len(own)) for name, own in sums.items() for c in own], f"name string, {channel} string, _size int")
    known = table.join(reference.select(channel).distinct(), channel, "left_semi")
    whole = known.groupBy("name").agg(F.count("*").alias("_there"), F.first("_size").alias("_of")).where("_there = _of").select("name")
    z = z_scores(scores, reference, [channel], score, "_z").join(F.broadcast(table.join(whole, "name", "left_semi")), channel)  # rows of the argument
    summed = z.groupBy(*keys, "name", "_size").agg(F.sum("_z").alias(out), F.count("*").alias("_n"))
    return summed.where("_n = _size").drop("_n", "_size")


def cell_survival(values: DataFrame, reference: DataFrame, cell: str, value: str, out: str = "evidence", kappa: float = KAPPA) -> DataFrame:
    """-log of a cell's survival function shrunk towards the scene's: (n S_cell + kappa S_scene + 1) / (n + kappa + 1).

    One table of counts by cell and value, kept, gives the ranks in the cell and, summed up over cells, in the scene.
    """
    counts = checkpointed(reference_counts(values, reference, [cell], value))
    every = totals_below(counts.groupBy(value).agg(F.sum("_ref").alias("_ref")), [], value, ["_ref"]).select(value, F.col("below__ref").alias("_scene"))
    sizes = counts.groupBy(cell).agg(F.sum("_ref").alias("_n")).where("_n > 0")
    whole = counts.agg(F.sum("_ref").alias("_all"))  # one row
    ranks = checkpointed(counts.select(cell, value, F.col("below__ref").alias("_own")).join(every, value))
    ranked = lookup(joined(values, ranks, [cell, value], measured(ranks), salts=1), sizes.crossJoin(F.broadcast(whole)), [cell])
    scene = (F.col("_all") - F.col("_scene")) / F.col("_all")
    return ranked.withColumn(out, -F.ln((F.col("_n") - F.col("_own") + kappa * scene + 1) / (F.col("_n") + kappa + 1))).drop("_own", "_scene", "_n", "_all")


def cell_tail(values: DataFrame, reference: DataFrame, cell: str, value: str, evidence: str, out: str, kappa: float = KAPPA) -> DataFrame:
    """The larger of the evidence and an exponential tail above the cell's own threshold, whose scale is shrunk to the scene's.

    The threshold is the value below the cell's largest tenth (one value at least).
    """
    counts, sizes = value_counts(reference.select(cell, value), [cell], value)
    ranked = counts.join(sizes, cell).withColumn("_k", F.greatest(F.lit(1), F.floor(F.col("_n") * 0.1))).withColumn("_above", F.col("_n") - F.col("below__c") - F.col("_c"))
    u = ranked.where((F.col("_above") <= F.col("_k")) & (F.col("_k") < F.col("_above") + F.col("_c"))).select(cell, F.col(value).alias("_u"))
    # of equal values at the threshold's rank only some are above it
    top = ranked.where(F.col("_above") < F.col("_k")).join(u, cell).withColumn("_times", F.least("_c", F.col("_k") - F.col("_above"))).withColumn("_excess", F.col("_times") * (F.col(value) - F.col("_u")))
    cells = top.groupBy(cell, "_u").agg((F.sum("_excess") / F.sum("_times")).alias("_own"), F.sum("_times").alias("_k"))
    scene = top.agg((F.sum("_excess") / F.sum("_times")).alias("_scene"))  # one row
    fit = cells.crossJoin(F.broadcast(scene)).select(cell, "_u", F.greatest((F.col("_k") * F.col("_own") + kappa * F.col("_scene")) / (F.col("_k") + kappa), F.col("_scene") * 1e-2 + 1e-9).alias("_beta"))
    tail = -math.log(0.1) + (F.col(value) - F.col("_u")) / F.col("_beta")
    joined = values.join(fit, cell, "left")
    return joined.withColumn(out, F.when(F.col(value) > F.col("_u"), F.greatest(F.col(evidence), tail)).otherwise(F.col(evidence))).drop("_u", "_beta")


def subsets(channels: list[str]) -> list[tuple[str, list[str]]]:
    """Every non-empty subset, by size and then in the order given, with its name."""
    return [("+".join(c), list(c)) for n in range(1, len(channels) + 1) for c in combinations(channels, n)]


def fuse_subsets(evidence: DataFrame, keys: list[str], channel: str, value: str, channels: list[str], out: str = "fused") -> DataFrame:
    """keys, subset, out: the fused value of every subset of channels, in one pass: a row is dealt to the subsets that have it."""
    spark = evidence.sparkSession
    table = spark.createDataFrame([(name, c, len(own)) for name, own in subsets(channels) for c in own], f"subset string, {channel} string, _size int")
    summed = evidence.join(F.broadcast(table), channel).groupBy(*keys, "subset", "_size").agg(F.sum(value).alias(out), F.count("*").alias("_n"))  # 2^channels rows, from the argument
    return summed.where("_n = _size").drop("_n", "_size")


def gate(df: DataFrame, score: str, quantile: float, check: str, out: str) -> DataFrame:
    """Scores over the quantile are gated: they are multiplied by twice the check's probability of an anomaly."""
    gated = F.col(score) > quantile
    return df.withColumn("gated", gated).withColumn(out, F.when(gated, F.col(score) * 2 * F.col(check)).otherwise(F.col(score)))


def alarm(scores: DataFrame, calibration: DataFrame, keys: list[str], score: str, quantile: float = 0.995) -> DataFrame:
    """scores with threshold (a quantile of the calibration scores) and alarm (strictly above it)."""
    return scores.join(exact_quantile(calibration, keys, score, quantile, "threshold"), keys).withColumn("alarm", F.col(score) > F.col("threshold"))
