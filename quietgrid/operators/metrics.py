"""Rank-based measures of scores against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .ranking import totals_below


def _by_score(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Distinct scores with their positives and negatives, and the negatives and positives below. The distinct scores are kept, as they are read twice."""
    distinct = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, F.col(score).alias("_score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    return totals_below(checkpointed(distinct), keys, "_score", ["pos", "neg"])


def auc(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """keys, n, auc: the chance that a positive scores over a negative, ties counting half; null where a class is missing."""
    keys = keys or []
    rows = _by_score(df, keys, score, label)
    won = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2))
    return rows.groupBy(*keys).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("auc"))


def macro_auc(df: DataFrame, score: str, label: str, series: str, keys: list[str] | None = None) -> DataFrame:
    """keys, series, auc: the mean of auc over series that have both classes."""
    keys = keys or []
    each = auc(df, score, label, [*keys, series]).where(F.col("auc").isNotNull())
    return each.groupBy(*keys).agg(F.count("*").alias("series"), F.avg("auc").alias("auc"))


def equal_error_rate(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """keys, eer: mean of the two error rates at the threshold where they differ least (the highest such threshold)."""
    keys = keys or []
    rows = _by_score(df, keys, score, label)
    whole = rows.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    rows = rows.join(whole, keys) if keys else rows.crossJoin(F.broadcast(whole))  # one row
    # at a threshold, scores from it on are alarms; one above all scores has none
    points = rows.select(*keys, "_score", "_p", "_n", ((F.col("_n") - F.col("below_neg")) / F.col("_n")).alias("fpr"), (F.col("below_pos") / F.col("_p")).alias("fnr"))
    top = whole.select(*keys, F.lit(float("inf")).alias("_score"), "_p", "_n", F.lit(0.0).alias("fpr"), F.lit(1.0).alias("fnr"))
    best = F.min_by(F.struct("fpr", "fnr"), F.struct(F.round(F.abs(F.col("fpr") - F.col("fnr")), 12), -F.col("_score")))
    return points.unionByName(top).groupBy(*keys).agg(best.alias("_best")).select(*keys, ((F.col("_best.fpr") + F.col("_best.fnr")) / 2).alias("eer"))


def class_rates(df: DataFrame, flag: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """keys, overall, anomalous, normal: the share of rows with the flag, in all and by class."""
    own, y = F.col(flag).cast("double"), F.col(label).cast("int") == 1
    return df.groupBy(*(keys or [])).agg(F.avg(own).alias("overall"), F.avg(F.when(y, own)).alias("anomalous"), F.avg(F.when(~y, own)).alias("normal"))


def tallies(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """keys, frames, positives, percent."""
    return df.groupBy(*keys).agg(F.count("*").alias("frames"), F.sum(F.col(label).cast("long")).alias("positives"), (100 * F.avg(F.col(label).cast("double"))).alias("percent"))


def first_best(df: DataFrame, keys: list[str], score: str, tie: list[str]) -> DataFrame:
    """The row with the largest score of each group; of equals the first by the columns in tie."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), *tie)
    return df.withColumn("_turn", F.row_number().over(order)).where("_turn = 1").drop("_turn")


def leave_one_out(results: DataFrame, dataset: str, choice: str, score: str) -> DataFrame:
    """held, choice, auc, chosen_on_mean: for each dataset the choice, of those it has, that is best on the mean of the others.

    results has a row per dataset and choice. The mean of the others is the choice's sum without the dataset's own score, so
    a choice's rows meet once and nothing is joined; null scores don't count. Ties go to the first choice in order.
    """
    of_choice = Window.partitionBy(choice)
    own = F.coalesce(score, F.lit(0.0))
    others = F.count(score).over(of_choice) - F.col(score).isNotNull().cast("int")
    rows = results.withColumn("chosen_on_mean", F.try_divide(F.sum(own).over(of_choice) - own, others)).where(F.col("chosen_on_mean").isNotNull())
    best = first_best(rows.withColumn("_rounded", F.round("chosen_on_mean", 9)), [dataset], "_rounded", [choice])
    return best.select(F.col(dataset).alias("held"), choice, F.col(score).alias("auc"), "chosen_on_mean")
