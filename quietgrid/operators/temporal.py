"""Filters along time. Every function takes a frame, its series keys, its time column and the value to filter.

All but min_max look at a bounded window, so a long series is never held as one array. Each edge rule is its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]


def _by(keys: Keys, order: str):
    return Window.partitionBy(*keys).orderBy(order)


def _neighbours(df: DataFrame, keys: Keys, order: str, value: str, radius: int, mode: str) -> tuple[DataFrame, Column]:
    """df with helper columns, and the array of 2 * radius + 1 values around each row.

    Beyond the ends, `nearest` repeats the end value and `reflect` mirrors the series with its end value doubled.
    """
    by = _by(keys, order)
    df = df.withColumn("_p", F.row_number().over(by) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    df = df.withColumn("_near", F.collect_list(value).over(by.rowsBetween(-radius, radius))).withColumn("_first", F.greatest(F.lit(0), F.col("_p") - radius))

    def index(k: Column) -> Column:
        at = F.col("_p") + k
        if mode == "nearest":
            return F.least(F.greatest(at, F.lit(0)), F.col("_n") - 1)
        turn = F.pmod(at, 2 * F.col("_n"))
        return F.when(turn < F.col("_n"), turn).otherwise(2 * F.col("_n") - 1 - turn)

    return df, F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda k: F.element_at(F.col("_near"), (index(k) - F.col("_first") + 1).cast("int")))


def _done(df: DataFrame, out: str, value: Column) -> DataFrame:
    return df.withColumn(out, value).drop("_p", "_n", "_near", "_first")


def centred_median(df: DataFrame, keys: Keys, order: str, value: str, out: str, width: int = 9) -> DataFrame:
    """Median of an odd window around the row; end values are repeated."""
    df, around = _neighbours(df, keys, order, value, width // 2, "nearest")
    return _done(df, out, F.element_at(F.array_sort(around), width // 2 + 1))


def causal_median_padded(df: DataFrame, keys: Keys, order: str, value: str, out: str, width: int = 9) -> DataFrame:
    """Median of the last `width` values; the series' first value stands before its start."""
    by = _by(keys, order)
    last = F.collect_list(value).over(by.rowsBetween(1 - width, 0))
    df = df.withColumn("_last", last).withColumn("_start", F.first(value).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    full = F.array_sort(F.concat(F.array_repeat(F.col("_start"), F.lit(width) - F.size("_last")), F.col("_last")))
    return df.withColumn(out, F.element_at(full, width // 2 + 1)).drop("_last", "_start")


def causal_median(df: DataFrame, keys: Keys, order: str, value: str, out: str, width: int = 9) -> DataFrame:
    """Median of the last `width` values, or of as many as there are."""
    return df.withColumn(out, F.percentile(value, 0.5).over(_by(keys, order).rowsBetween(1 - width, 0)))


def steady_gain(q_over_r: float) -> float:
    """The gain that the local-level filter settles to: that of the fixed point of its variance recursion."""
    # p = (p + q) / (p + q + 1) has the positive solution below
    p = (-q_over_r + math.sqrt(q_over_r * q_over_r + 4 * q_over_r)) / 2
    return (p + q_over_r) / (p + q_over_r + 1)


def _memory(gain: float) -> int:
    """Values after which the weight of all earlier ones is under 1e-18."""
    return math.ceil(math.log(1e-18) / math.log(1 - gain))


def _folded(values: Column, gain: float) -> Column:
    return F.aggregate(values, F.element_at(values, 1), lambda x, z: x + F.lit(gain) * (z - x))


def causal_kalman(df: DataFrame, keys: Keys, order: str, value: str, out: str, gain: float) -> DataFrame:
    """x += gain * (z - x), from the first value on. Values too old to count in double precision are left out."""
    last = F.collect_list(value).over(_by(keys, order).rowsBetween(-_memory(gain), 0))
    return df.withColumn("_last", last).withColumn(out, _folded(F.col("_last"), gain)).drop("_last")


def fixed_lag_kalman(df: DataFrame, keys: Keys, order: str, value: str, out: str, gain: float, lag: int = 4) -> DataFrame:
    """Mean of the forward filter and a backward one over the next `lag` values; the last row has the forward one alone."""
    df = causal_kalman(df, keys, order, value, "_forward", gain)
    df = df.withColumn("_next", F.collect_list(value).over(_by(keys, order).rowsBetween(0, lag)))
    both = (F.col("_forward") + _folded(F.reverse("_next"), gain)) / 2
    return df.withColumn(out, F.when(F.size("_next") > 1, both).otherwise(F.col("_forward"))).drop("_forward", "_next")


def gaussian(df: DataFrame, keys: Keys, order: str, value: str, out: str, sigma: float = 3.0, mode: str = "nearest") -> DataFrame:
    """Gaussian smoothing cut off at four sigmas; mode is the rule beyond the ends: nearest or reflect."""
    radius = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    scale = sum(weights)
    df, around = _neighbours(df, keys, order, value, radius, mode)
    known = F.array(*(F.lit(w / scale) for w in weights))
    return _done(df, out, F.aggregate(F.zip_with(around, known, lambda a, w: a * w), F.lit(0.0), lambda s, x: s + x))


def min_max(df: DataFrame, keys: Keys, value: str, out: str) -> DataFrame:
    """(value - least) / (largest - least + 1e-12) within a series. Ends come from partial minima, so no series is held as a whole."""
    ends = df.groupBy(*(F.col(k).alias(f"_end_{k}") for k in keys)).agg(F.min(value).alias("_least"), F.max(value).alias("_largest"))
    on = [F.col(k).eqNullSafe(F.col(f"_end_{k}")) for k in keys]
    return df.join(ends, on).withColumn(out, (F.col(value) - F.col("_least")) / (F.col("_largest") - F.col("_least") + 1e-12)).drop("_least", "_largest", *(f"_end_{k}" for k in keys))


def lag_difference(df: DataFrame, keys: Keys, order: str, value: str, out: str, gap: int = 2) -> DataFrame:
    """value minus that `gap` rows before; the first `gap` rows take over the difference of row `gap` (null if there is none)."""
    by = _by(keys, order)
    own = F.col(value) - F.lag(value, gap).over(by)
    df = df.withColumn("_own", own)
    return df.withColumn(out, F.coalesce("_own", F.first("_own", ignorenulls=True).over(by.rowsBetween(0, gap)))).drop("_own")


def causal_hold(df: DataFrame, keys: Keys, order: str, value: str, out: str, stride: int = 4) -> DataFrame:
    """Rows between scored ones (every stride-th) keep the last scored value."""
    by = _by(keys, order)
    scored = F.when((F.row_number().over(by) - 1) % stride == 0, F.col(value))
    df = df.withColumn("_scored", scored)
    return df.withColumn(out, F.last("_scored", ignorenulls=True).over(by.rowsBetween(1 - stride, 0))).drop("_scored")


def clips(df: DataFrame, keys: Keys, order: str, value: str, out: str, length: int = 4, step: int = 2) -> DataFrame:
    """The last `length` values, `step` apart, ending at the row. Rows before the first whole clip have that clip;
    a series too short for one repeats its first value in front."""
    span = (length - 1) * step
    by = _by(keys, order)
    df = df.withColumn("_p", F.row_number().over(by) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    # a window that reaches ahead as far as the first whole clip
    df = df.withColumn("_near", F.collect_list(value).over(by.rowsBetween(-span, span))).withColumn("_first", F.greatest(F.lit(0), F.col("_p") - span))
    end = F.least(F.greatest(F.col("_p"), F.lit(span)), F.col("_n") - 1)
    picked = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.element_at(F.col("_near"), (F.greatest(F.lit(0), end - span + k * step) - F.col("_first") + 1).cast("int")))
    return df.withColumn(out, picked).drop("_p", "_n", "_near", "_first")
