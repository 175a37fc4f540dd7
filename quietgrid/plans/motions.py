"""Queries of motion features; displacements are taken from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import channels as K
from ..operators import motion as M
from ..operators.flow import optical_flow
from ..operators.ranking import quantile
from ..operators.skew import skewed_background
from .bindings import HEIGHT, WIDTH, rounded, table, vectors
from .register import query

_FLOW = f"""flow AS (
  SELECT (year(l_shipdate) * 12 + month(l_shipdate))::INT AS frame, l_suppkey % 12 AS y, l_partkey % 10 AS x, (l_quantity - 25.3::DOUBLE) / 10 AS dx, (l_linenumber - 3.7::DOUBLE) / 2 AS dy FROM lineitem),
polar AS (SELECT *, sqrt(dx * dx + dy * dy) AS m, atan2(dy, dx) + CASE WHEN atan2(dy, dx) < 0 THEN 2 * pi() ELSE 0 END AS a FROM flow),
binned AS (SELECT frame, (y // 4 * 3 + x // 4)::INT AS cell_id, m, least(floor(a / (2 * pi()) * 8), 7)::INT AS b FROM polar),
feats AS (SELECT frame, cell_id, {", ".join(f"ln(1 + coalesce(sum(m) FILTER (b = {k}), 0) / 16) AS f{k}" for k in range(8))}, ln(1 + max(m)) AS f8 FROM binned GROUP BY 1, 2)"""


def _flow(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select((F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("frame"), (F.col("l_suppkey") % 12).alias("y"), (F.col("l_partkey") % 10).alias("x"), ((F.col("l_quantity") - 25.3) / 10).alias("dx"), ((F.col("l_linenumber") - 3.7) / 2).alias("dy"))


@query(f"WITH {_FLOW} SELECT frame, cell_id, {', '.join(f'round(f{k}, 6) AS f{k}' for k in range(9))} FROM feats")
def flow_features(spark, sf_dir):
    rows = M.flow_features(_flow(spark, sf_dir), ["frame"], 4, 10)
    names = [f"f{k}" for k in range(9)]
    return rounded(rows.select("frame", "cell_id", *(F.col("f")[k].alias(n) for k, n in enumerate(names))), *names)


@query(f"WITH {_FLOW} SELECT frame, cell_id, round(ln(1 + {' + '.join(f'(exp(f{k}) - 1)' for k in range(8))}), 6) AS mean, round(f8, 6) AS largest FROM feats")
def flow_speed(spark, sf_dir):
    s = M.speed(F.col("f"))
    rows = M.flow_features(_flow(spark, sf_dir), ["frame"], 4, 10).select("frame", "cell_id", s.alias("s"))
    return rounded(rows.select("frame", "cell_id", F.col("s")[0].alias("mean"), F.col("s")[1].alias("largest")), "mean", "largest")


@query("SELECT l_orderkey, l_linenumber, least(255, round(l_extendedprice * (96.0::DOUBLE / greatest((SELECT quantile_cont(l_extendedprice, 0.999) FROM lineitem), 1e-3))))::INT AS level FROM lineitem")
def quantised_magnitude(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    scaled = rows.crossJoin(F.broadcast(quantile(rows, [], "l_extendedprice", 0.999, "top")))  # one row
    return scaled.select("l_orderkey", "l_linenumber", S.quantised(F.col("l_extendedprice"), F.col("top")).alias("level"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, [l_quantity / 10, l_tax * 100, l_discount * 100] AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, round(ln(exp(a[1]) + exp(a[2]) + exp(a[3])), 6) AS lse, round(exp(a[1]) / (exp(a[1]) + exp(a[2]) + exp(a[3])), 6) AS p0, round(1 / (1 + exp(-(a[2] - a[3]))), 6) AS odds FROM v""")
def log_domain(spark, sf_dir):
    a = F.array(F.col("l_quantity") / 10, F.col("l_tax") * 100, F.col("l_discount") * 100)
    rows = table(spark, sf_dir, "lineitem").withColumn("a", a)
    return rounded(rows.select("l_orderkey", "l_linenumber", S.logsumexp(F.col("a")).alias("lse"), S.softmax(F.col("a"))[0].alias("p0"), S.sigmoid(F.col("a")[1] - F.col("a")[2]).alias("odds")), "lse", "p0", "odds")


@query()
def skewed_background_scores(spark, sf_dir):
    """A skewed t background by cell; tested against numerical integration and simulated data."""
    return skewed_background(vectors(spark, sf_dir), "cell", "f", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "skew_t")


@query()
def motion_channels(spark, sf_dir):
    """Frame scores of the three flow channels, learned from even months; tested against NumPy."""
    features = M.flow_features(_flow(spark, sf_dir), ["frame"], 4, 10)
    cells = K.flow_channels(features, features.where("frame % 2 = 0"), ["frame"], components=2)
    return K.frame_channels(cells, ["frame"], [K.FLOW_UBM, K.FLOW_RX, K.FLOW_ST], HEIGHT, WIDTH, 4, 4)


@query()
def dense_flow(spark, sf_dir):
    """Sub-pixel displacements between the maps of neighbouring months; drawn shifts are recovered in tests."""
    from .caches import month_frames

    return rounded(optical_flow(month_frames(spark, sf_dir), ["scene", "split", "video"], "t").drop("scene"), "dx", "dy")
