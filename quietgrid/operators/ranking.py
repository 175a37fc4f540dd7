"""Running totals by value, without putting a whole key's values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets in a factor of e: values of a bucket differ by 0.4 % at most.
FINENESS = 256
_ZERO, _MOST = 1 << 18, 1 << 21


def bucket(value: Column, fineness: int = FINENESS) -> Column:
    """A number that never falls as the value grows: of the logarithm, which is monotonic in floating point, as are its
    product with a constant and floor(). Zero has a bucket of its own; infinities and NaN (the largest) are at the ends."""
    v = value.cast("double")
    size = F.floor(F.least(F.ln(F.abs(v)) * fineness, F.lit(1e6))) + _ZERO
    return F.when(v.isNull(), None).when(F.isnan(v), _MOST + 1).when(v == 0, 0).when(v > 0, size).otherwise(-size).cast("long")


def totals_below(distinct: DataFrame, keys: list[str], value: str, sums: list[str], fineness: int = FINENESS) -> DataFrame:
    """Adds below_<name> for each of sums: the total over rows with the same keys and a smaller value.

    distinct has a row per (keys, value). Totals of whole buckets of values come from one small window, totals within a
    bucket from another, so a task has a bucket's rows and not a key's. Buckets only deal out work: results are exact.
    """
    by = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("_key0")]
    names = [f"_key{i}" for i in range(len(by))]
    rows = distinct.select("*", *by, bucket(F.col(value), fineness).alias("_bucket"))
    whole = rows.groupBy(*names, "_bucket").agg(*(F.sum(s).alias(f"_{s}") for s in sums))
    earlier = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*names, "_bucket", *(F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}") for s in sums))
    rows = rows.join(whole, [*names, "_bucket"])
    inside = Window.partitionBy(*names, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *((F.col(f"_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"below_{s}") for s in sums))
    return rows.select(*distinct.columns, *(f"below_{s}" for s in sums))


def reference_counts(queries: DataFrame, reference: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, _ref, below__ref: reference rows at and below every value of either frame."""
    both = queries.select(*keys, value, F.lit(0).cast("long").alias("_ref")).unionByName(reference.select(*keys, value, F.lit(1).cast("long").alias("_ref")))
    return totals_below(both.groupBy(*keys, value).agg(F.sum("_ref").alias("_ref")), keys, value, ["_ref"])


def counts_below(queries: DataFrame, reference: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """queries with the number of reference rows (same keys) whose value is less: a left-sided search in sorted values."""
    found = reference_counts(queries, reference, keys, value).select(*keys, value, F.col("below__ref").alias(out))
    return queries.join(found, [*keys, value])


def picked_quantile(counts: DataFrame, sizes: DataFrame, keys: list[str], value: str, number: str, q: float, out: str) -> DataFrame:
    """keys and the quantile, linear between neighbours, of values with their numbers of rows and of rows below.

    sizes: keys, _n. It takes the two rows around the quantile's rank, so no task holds a key's values.
    """
    place = F.lit(q) * (F.col("_n") - 1)
    rows = counts.join(sizes, keys) if keys else counts.crossJoin(F.broadcast(sizes))  # one row
    below, own = F.col(f"below_{number}"), F.col(number)
    at = lambda i: F.max(F.when((below <= i) & (i < below + own), F.col(value)))
    near = rows.where((below <= F.ceil(place)) & (F.floor(place) < below + own))
    ends = near.groupBy(*keys).agg(at(F.floor(place)).alias("_lo"), at(F.ceil(place)).alias("_hi"), F.first(place - F.floor(place)).alias("_part"))
    return ends.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias(out))


def value_counts(df: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(keys, value, _c, below__c: rows at and below each value; keys, _n: all rows), nulls left out."""
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    return totals_below(distinct, keys, value, ["_c"]), distinct.groupBy(*keys).agg(F.sum("_c").alias("_n"))


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """keys and the exact quantiles of their values by name, nulls left out."""
    counts, sizes = value_counts(df, keys, value)
    found = [picked_quantile(counts, sizes, keys, value, "_c", q, name) for name, q in wanted.items()]
    out = found[0]
    for other in found[1:]:
        out = out.join(other, keys) if keys else out.crossJoin(F.broadcast(other))  # one row
    return out


def quantile(df: DataFrame, keys: list[str], value: str, q: float, out: str) -> DataFrame:
    """keys and the exact quantile of their values, nulls left out."""
    return quantiles(df, keys, value, {out: q})
