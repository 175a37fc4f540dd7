"""Queries of calibration, fusion, measures and protocols."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import calibrate as C
from ..operators import metrics as M
from ..operators import temporal as T
from ..operators.ranking import quantiles
from ..session import checkpointed
from .bindings import FRAMES, frames, rounded
from .register import query
from .series import GAIN

#: Three channels of a frame: its value, a property of the event, the distance of its value from the mean of ln(1 + value).
CHANNELS = ["k", "x", "xx"]
_LONG = """long AS (SELECT event_id, video, t, y, 'x' AS channel, x AS score FROM frames UNION ALL SELECT event_id, video, t, y, 'k', k FROM frames
  UNION ALL SELECT event_id, video, t, y, 'xx', (x - 3) * (x - 3) FROM frames)"""
_TAIL = """ref AS (SELECT channel, score FROM long WHERE y = 0),
cut AS (SELECT channel, quantile_cont(score, 0.9) AS u, count(*) AS n FROM ref GROUP BY 1),
fit AS (SELECT channel, u, n, greatest(coalesce((SELECT avg(score - u) FROM ref r WHERE r.channel = cut.channel AND score > u), 1e-6), 1e-6) AS beta FROM cut),
vals AS (SELECT channel, score, sum(is_ref) AS n FROM (SELECT channel, score, 0 AS is_ref FROM long UNION ALL SELECT channel, score, 1 FROM ref) GROUP BY 1, 2),
below AS (SELECT channel, score, coalesce(sum(n) OVER (PARTITION BY channel ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM vals),
ev AS (SELECT l.event_id, l.video, l.t, l.y, l.channel, CASE WHEN l.score > u THEN -ln(0.1::DOUBLE) + (l.score - u) / beta ELSE -ln((n - b + 1)::DOUBLE / (n + 1)) END AS evidence
  FROM long l JOIN fit USING (channel) JOIN below USING (channel, score))"""


def channels(spark, sf_dir):
    """event_id, video, t, y, channel, score; kept, as scores and references both come from it."""
    df = frames(spark, sf_dir).withColumn("xx", (F.col("x") - 3) * (F.col("x") - 3))
    return checkpointed(_channels(df))


def _channels(df):
    return df.select("event_id", "video", "t", "y", F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("score")) for c in CHANNELS))).alias("c")).select("event_id", "video", "t", "y", "c.channel", "c.score")


def evidence(spark, sf_dir):
    long = channels(spark, sf_dir)
    return C.tail_evidence(long, long.where("y = 0").select("channel", "score"), ["channel"], "score")


def auc_sql(source: str, score: str = "s", keys: str = "") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}count(*) AS n, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc
FROM (SELECT *, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER (PARTITION BY {lead}{score}) - 1) / 2.0::DOUBLE AS r FROM {source}) {f'GROUP BY {keys}' if keys else ''}"""


@query(f"WITH {FRAMES}, {_LONG}, f AS (SELECT channel, avg(score) AS m, stddev_pop(score) + 1e-12 AS sd FROM long WHERE y = 0 GROUP BY 1) SELECT event_id, channel, round((score - m) / sd, 6) AS z FROM long JOIN f USING (channel)")
def z_normaliser(spark, sf_dir):
    long = channels(spark, sf_dir)
    return rounded(C.z_scores(long, long.where("y = 0").select("channel", "score"), ["channel"], "score").select("event_id", "channel", "z"), "z")


@query(f"WITH {FRAMES}, {_LONG}, {_TAIL} SELECT event_id, channel, round(evidence, 6) AS evidence FROM ev")
def tail_normaliser(spark, sf_dir):
    return rounded(evidence(spark, sf_dir).select("event_id", "channel", "evidence"), "evidence")


@query(f"WITH {FRAMES}, {_LONG}, {_TAIL} SELECT event_id, round(sum(evidence), 6) AS fused FROM ev GROUP BY 1")
def fisher_fusion(spark, sf_dir):
    return rounded(C.fuse(evidence(spark, sf_dir), ["event_id"], "channel", "evidence", channels=CHANNELS), "fused")


@query(f"WITH {FRAMES} {auc_sql('frames', 'x')}")
def auc_micro(spark, sf_dir):
    return rounded(M.auc(frames(spark, sf_dir), "x", "y"), "auc")


@query(f"WITH {FRAMES}, e AS ({auc_sql('frames', 'x', 'video')}) SELECT count(*) AS series, round(avg(auc), 5) AS auc FROM e WHERE auc IS NOT NULL")
def auc_macro(spark, sf_dir):
    return rounded(M.macro_auc(frames(spark, sf_dir), "x", "y", "video"), "auc", digits=5)


@query(f"""WITH {FRAMES}, d AS (SELECT x AS s, sum(y) AS pos, sum(1 - y) AS neg FROM frames GROUP BY 1),
p AS (SELECT s, sum(neg) OVER (ORDER BY s DESC)::DOUBLE / sum(neg) OVER () AS fpr, 1 - sum(pos) OVER (ORDER BY s DESC)::DOUBLE / sum(pos) OVER () AS fnr FROM d
  UNION ALL SELECT 'infinity'::DOUBLE, 0, 1)
SELECT round((fpr + fnr) / 2, 6) AS eer FROM p ORDER BY round(abs(fpr - fnr), 12), s DESC LIMIT 1""")
def equal_error_rate(spark, sf_dir):
    return rounded(M.equal_error_rate(frames(spark, sf_dir), "x", "y"), "eer")


def _protocols(df):
    """video, t, y, protocol, s: a fused score under each temporal filter. All filters share one sort by video and time."""
    by = (["video"], "t", "fused")
    df = T.centred_median(df, *by, "centred-median")
    df = T.causal_median_padded(df, *by, "causal-median")
    df = T.causal_kalman(df, *by, "causal-kalman", GAIN)
    df = T.fixed_lag_kalman(df, *by, "fixed-lag-kalman", GAIN)
    df = T.gaussian(T.min_max(df, ["video"], "fused", "_unit"), ["video"], "t", "_unit", "min-max-gaussian")
    names = {"raw": "fused"} | {n: n for n in ("centred-median", "causal-median", "causal-kalman", "fixed-lag-kalman", "min-max-gaussian")}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("protocol"), F.round(F.col(f"`{c}`"), 9).alias("s")) for n, c in names.items())))
    return df.select("video", "t", "y", each.alias("p")).select("video", "t", "y", "p.protocol", "p.s")


_P = f"""fz AS (SELECT event_id, video, t, y, sum(evidence) AS f FROM ev GROUP BY 1, 2, 3, 4),
s0 AS (SELECT *, list(f) OVER w AS l, count(*) OVER w AS n, min(f) OVER w AS lo, max(f) OVER w AS hi FROM fz WINDOW w AS (PARTITION BY video ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
wt AS (SELECT list(exp(-0.5 * (k / 3.0::DOUBLE) * (k / 3.0::DOUBLE)) ORDER BY k) AS w FROM range(-12, 13) r(k)),
s1 AS (
  SELECT video, t, y, f AS raw, list_sort([l[greatest(0, least(p, n - 1)) + 1] FOR p IN range(t - 4, t + 5)])[5] AS cm,
    list_sort([l[greatest(0, p) + 1] FOR p IN range(t - 8, t + 1)])[5] AS pm,
    list_reduce(l[1:t + 1], lambda a, b: a + {GAIN!r} * (b - a)) AS kf,
    CASE WHEN t + 1 < n THEN 0.5 * list_reduce(l[1:t + 1], lambda a, b: a + {GAIN!r} * (b - a)) + 0.5 * list_reduce(list_reverse(l[t + 1:t + 5]), lambda a, b: a + {GAIN!r} * (b - a))
      ELSE list_reduce(l[1:t + 1], lambda a, b: a + {GAIN!r} * (b - a)) END AS fl,
    list_sum([(l[greatest(0, least(p, n - 1)) + 1] - lo) / (hi - lo + 1e-12) * w[p - t + 13] FOR p IN range(t - 12, t + 13)]) / list_sum(w) AS g
  FROM s0 CROSS JOIN wt),
pr AS (SELECT video, t, y, 'raw' AS protocol, round(raw, 9) AS s FROM s1 UNION ALL SELECT video, t, y, 'centred-median', round(cm, 9) FROM s1 UNION ALL SELECT video, t, y, 'causal-median', round(pm, 9) FROM s1
  UNION ALL SELECT video, t, y, 'causal-kalman', round(kf, 9) FROM s1 UNION ALL SELECT video, t, y, 'fixed-lag-kalman', round(fl, 9) FROM s1 UNION ALL SELECT video, t, y, 'min-max-gaussian', round(g, 9) FROM s1)"""


@query(f"WITH {FRAMES}, {_LONG}, {_TAIL}, {_P}, a AS ({auc_sql('pr', 's', 'protocol')}) SELECT protocol, n, round(auc, 5) AS auc FROM a")
def protocol_comparison(spark, sf_dir):
    ev = evidence(spark, sf_dir)
    fused = checkpointed(C.fuse(ev, ["event_id", "video", "t", "y"], "channel", "evidence"))
    return rounded(M.auc(_protocols(fused), "s", "y", ["protocol"]), "auc", digits=5)


_SUBSETS = "subs AS (SELECT * FROM (VALUES " + ", ".join(f"('{name}', '{c}', {len(own)})" for name, own in C.subsets(CHANNELS) for c in own) + ") s(subset, channel, size))"
_RES = f"""{_SUBSETS},
both_n AS (SELECT event_id, video, y, channel, 'fisher' AS norm, evidence AS v FROM ev
  UNION ALL SELECT event_id, video, y, channel, 'z', (score - m) / sd FROM long JOIN (SELECT channel, avg(score) AS m, stddev_pop(score) + 1e-12 AS sd FROM long WHERE y = 0 GROUP BY 1) USING (channel)),
fs AS (SELECT (video % 3)::INT AS ds, event_id, y, norm, subset, round(sum(v), 9) AS s FROM both_n JOIN subs USING (channel) GROUP BY 1, 2, 3, 4, 5),
res AS ({auc_sql('fs', 's', 'ds, norm, subset')})"""


def _results(spark, sf_dir):
    """ds, norm, subset, n, auc. Data sets are the cameras' numbers modulo 3."""
    long = channels(spark, sf_dir)
    ref = long.where("y = 0").select("channel", "score")
    ds = (F.col("video") % 3).cast("int").alias("ds")
    fisher = C.tail_evidence(long, ref, ["channel"], "score", "v").select("event_id", ds, "y", "channel", F.lit("fisher").alias("norm"), "v")
    z = C.z_scores(long, ref, ["channel"], "score", "v").select("event_id", ds, "y", "channel", F.lit("z").alias("norm"), "v")
    fused = C.fuse_subsets(fisher.unionByName(z), ["ds", "event_id", "y", "norm"], "channel", "v", CHANNELS, "s")
    return M.auc(fused.withColumn("s", F.round("s", 9)), "s", "y", ["ds", "norm", "subset"])


@query(f"WITH {FRAMES}, {_LONG}, {_TAIL}, {_RES} SELECT ds, norm, subset, n, round(auc, 4) AS auc FROM res")
def subset_search(spark, sf_dir):
    return rounded(_results(spark, sf_dir), "auc", digits=4)


@query(f"""WITH {FRAMES}, {_LONG}, {_TAIL}, {_RES},
r AS (SELECT ds, norm || ':' || subset AS choice, round(auc, 4) AS auc FROM res),
o AS (SELECT h.ds AS held, r.choice, avg(r.auc) AS m FROM (SELECT DISTINCT ds FROM r) h JOIN r ON r.ds <> h.ds GROUP BY 1, 2),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY held ORDER BY round(m, 9) DESC, choice) = 1)
SELECT b.held, b.choice, r.auc, round(b.m, 6) AS chosen_on_mean FROM b JOIN r ON r.ds = b.held AND r.choice = b.choice""")
def leave_one_out(spark, sf_dir):
    res = checkpointed(rounded(_results(spark, sf_dir), "auc", digits=4)).select("ds", F.concat_ws(":", "norm", "subset").alias("choice"), "auc")
    return rounded(M.leave_one_out(res, "ds", "choice", "auc"), "chosen_on_mean")


@query(f"WITH {FRAMES}, {_LONG}, {_TAIL}, {_RES} SELECT norm, subset, round(avg(round(auc, 4)), 6) AS mean FROM res GROUP BY 1, 2 ORDER BY round(avg(round(auc, 4)), 9) DESC, norm, subset LIMIT 10")
def top_combinations(spark, sf_dir):
    mean = rounded(_results(spark, sf_dir), "auc", digits=4).groupBy("norm", "subset").agg(F.avg("auc").alias("mean"))
    return rounded(mean.orderBy(F.desc(F.round("mean", 9)), "norm", "subset").limit(10), "mean")


@query(f"""WITH {FRAMES}, s AS (SELECT *, (video % 4)::INT AS scene FROM frames),
ref AS (SELECT scene, x FROM s WHERE y = 0), cut AS (SELECT scene, quantile_cont(x, 0.9) AS u, count(*) AS n FROM ref GROUP BY 1),
fit AS (SELECT scene, u, n, (SELECT greatest(avg(x - u), 1e-6) FROM ref r WHERE r.scene = cut.scene AND x > u) AS beta FROM cut),
e AS (SELECT s.event_id, s.y, round(CASE WHEN s.x > u THEN -ln(0.1::DOUBLE) + (s.x - u) / beta ELSE -ln((n - (SELECT count(*) FROM ref r WHERE r.scene = s.scene AND r.x < s.x) + 1)::DOUBLE / (n + 1)) END, 9) AS s FROM s JOIN fit USING (scene))
{auc_sql('e')}""")
def multi_scene_pooling(spark, sf_dir):
    """Each scene is calibrated on its own normal frames; frames are then pooled."""
    df = frames(spark, sf_dir).withColumn("scene", (F.col("video") % 4).cast("int"))
    ev = C.tail_evidence(df, df.where("y = 0").select("scene", "x"), ["scene"], "x", "s")
    return rounded(M.auc(ev.withColumn("s", F.round("s", 9)), "s", "y"), "auc")


@query(f"""WITH {FRAMES}, v AS (SELECT *, (t % 6)::INT AS cell FROM frames), ref AS (SELECT cell, x FROM v WHERE y = 0),
c AS (SELECT event_id, v.cell, (SELECT count(*) FROM ref r WHERE r.cell = v.cell) AS n, (SELECT count(*) FROM ref r WHERE r.cell = v.cell AND r.x < v.x) AS own,
  (SELECT count(*) FROM ref) AS tot, (SELECT count(*) FROM ref r WHERE r.x < v.x) AS sc FROM v)
SELECT event_id, cell, round(-ln((n - own + 20 * ((tot - sc)::DOUBLE / tot) + 1) / (n + 20 + 1)), 6) AS evidence FROM c""")
def cell_survival(spark, sf_dir):
    df = frames(spark, sf_dir).withColumn("cell", (F.col("t") % 6).cast("int"))
    return rounded(C.cell_survival(df, df.where("y = 0").select("cell", "x"), "cell", "x").select("event_id", "cell", "evidence"), "evidence")


@query(f"""WITH {FRAMES}, v AS (SELECT *, (t % 6)::INT AS cell FROM frames),
rk AS (SELECT cell, x, row_number() OVER (PARTITION BY cell ORDER BY x DESC) AS r, count(*) OVER (PARTITION BY cell) AS n FROM v WHERE y = 0),
k AS (SELECT *, greatest(1, floor(n * 0.1::DOUBLE)) AS k FROM rk), u AS (SELECT cell, x AS u FROM k WHERE r = k + 1),
ex AS (SELECT k.cell, u, k.x - u AS e FROM k JOIN u USING (cell) WHERE r <= k),
b AS (SELECT cell, u, greatest((count(*) * avg(e) + 20 * (SELECT avg(e) FROM ex)) / (count(*) + 20), (SELECT avg(e) FROM ex) * 1e-2 + 1e-9) AS beta FROM ex GROUP BY 1, 2)
SELECT event_id, round(CASE WHEN x > u THEN greatest(0.5::DOUBLE, -ln(0.1::DOUBLE) + (x - u) / beta) ELSE 0.5::DOUBLE END, 6) AS e FROM v LEFT JOIN b USING (cell)""")
def cell_tail(spark, sf_dir):
    df = frames(spark, sf_dir).withColumn("cell", (F.col("t") % 6).cast("int")).withColumn("half", F.lit(0.5))
    return rounded(C.cell_tail(df, df.where("y = 0").select("cell", "x"), "cell", "x", "half", "e").select("event_id", "e"), "e")


#: The 0.9 quantile of a Gamma distribution with shape 3 and scale 1: a sum of three calibrated channels exceeds it in a tenth of normal frames.
GATE = 5.3223


@query(f"""WITH {FRAMES}, {_LONG}, {_TAIL}, f AS (SELECT event_id, y, sum(evidence) AS f FROM ev GROUP BY 1, 2), g AS (SELECT f.*, k / 100 AS p FROM f JOIN frames USING (event_id))
SELECT round(avg((f > {GATE})::INT), 6) AS overall, round(avg((f > {GATE})::INT) FILTER (y = 1), 6) AS anomalous, round(avg((f > {GATE})::INT) FILTER (y = 0), 6) AS normal,
  round(sum(CASE WHEN f > {GATE} THEN f * 2 * p ELSE f END), 3) AS checked FROM g""")
def gated_cascade(spark, sf_dir):
    fused = C.fuse(evidence(spark, sf_dir), ["event_id", "y"], "channel", "evidence")
    rows = fused.join(frames(spark, sf_dir).select("event_id", (F.col("k") / 100).alias("p")), "event_id")
    gated = C.gate(rows, "fused", GATE, "p", "checked")
    rates = M.class_rates(gated, "gated", "y").crossJoin(gated.agg(F.round(F.sum("checked"), 3).alias("checked")))  # a row each
    return rounded(rates, "overall", "anomalous", "normal")


@query(f"""WITH {FRAMES}, m AS (SELECT *, median(x) OVER (PARTITION BY video ORDER BY t ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS s FROM frames),
c AS (SELECT quantile_cont(s, 0.995) AS u FROM (SELECT median(x) OVER (PARTITION BY video ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS s FROM frames WHERE t % 2 = 0 AND y = 0))
SELECT event_id, round(s, 6) AS s, round(u, 6) AS threshold, s > u AS alarm FROM m CROSS JOIN c""")
def alarm_rule(spark, sf_dir):
    """Calibration takes every second normal frame, so its median is over half as many."""
    df = frames(spark, sf_dir)
    cal = T.causal_median(df.where("t % 2 = 0 and y = 0"), ["video"], "t", "x", "s", 4).withColumn("one", F.lit(1))
    rows = C.alarm(T.causal_median(df, ["video"], "t", "x", "s").withColumn("one", F.lit(1)), cal, ["one"], "s")
    return rounded(rows.select("event_id", "s", "threshold", "alarm"), "s", "threshold")


@query(f"""WITH {FRAMES}, v AS (SELECT video, ((row_number() OVER (ORDER BY video) - 1) % 2)::INT AS fold FROM (SELECT DISTINCT video FROM frames)),
r AS (SELECT frames.*, fold FROM frames JOIN v USING (video)), s AS (SELECT fold, avg(x) AS m, stddev_pop(x) + 1e-12 AS sd FROM r WHERE y = 0 GROUP BY 1)
SELECT event_id, r.fold, round((x - m) / sd, 6) AS z FROM r JOIN s ON s.fold = 1 - r.fold WHERE y = 0""")
def cross_fitted_reference(spark, sf_dir):
    """Normal frames are scored with the other fold's statistics."""
    df = C.folds(frames(spark, sf_dir), [], "video").where("y = 0")
    fit = df.select((1 - F.col("fold")).alias("fold"), "x")
    return rounded(C.z_scores(df, fit, ["fold"], "x").select("event_id", "fold", "z"), "z")


_FUSED = {"mc_all": ["k", "x", "xx"], "mc_pair": ["k", "x"], "mc_unknown": ["x", "none"]}


@query(f"""WITH {FRAMES}, {_LONG}, f AS (SELECT channel, avg(score) AS m, stddev_pop(score) + 1e-12 AS sd FROM long WHERE y = 0 GROUP BY 1),
z AS (SELECT event_id, channel, (score - m) / sd AS z FROM long JOIN f USING (channel))
SELECT event_id, 'mc_all' AS name, round(sum(z), 6) AS fused FROM z GROUP BY 1 UNION ALL SELECT event_id, 'mc_pair', round(sum(z), 6) FROM z WHERE channel IN ('k', 'x') GROUP BY 1""")
def channel_sums(spark, sf_dir):
    """Sums of z-scores over sets of channels; the set with a channel that isn't there is skipped."""
    long = channels(spark, sf_dir)
    return rounded(C.fuse_z(long, long.where("y = 0").select("channel", "score"), ["event_id"], "channel", "score", _FUSED), "fused")


@query(f"""WITH {FRAMES}, v AS (SELECT video, ((row_number() OVER (ORDER BY video) - 1) % 2)::INT AS fold FROM (SELECT DISTINCT video FROM frames WHERE y = 0)),
s AS (SELECT frames.*, fold, (t % 6)::INT AS cell FROM frames JOIN v USING (video) WHERE y = 0),
g AS (SELECT fold, avg(x) AS gm, var_pop(x) AS gv FROM s GROUP BY 1), c AS (SELECT fold, cell, avg(x) AS m, var_pop(x) AS v FROM s GROUP BY 1, 2),
b AS (SELECT fold, cell, (m + gm) / 2 AS m, (v + gv) / 2 + (m - gm) * (m - gm) / 4 AS v FROM c JOIN g USING (fold)),
g1 AS (SELECT avg(x) AS gm, var_pop(x) AS gv FROM s), c1 AS (SELECT cell, avg(x) AS m, var_pop(x) AS v FROM s GROUP BY 1),
b1 AS (SELECT cell, (m + gm) / 2 AS m, (v + gv) / 2 + (m - gm) * (m - gm) / 4 AS v FROM c1 CROSS JOIN g1),
ref AS (SELECT (s.x - b.m) * (s.x - b.m) / (b.v * (1 + 1e-3) + 1e-8) AS d FROM s JOIN b ON b.fold = 1 - s.fold AND b.cell = s.cell WHERE t % 3 = 0),
sc AS (SELECT avg(d) AS m, stddev_pop(d) + 1e-12 AS sd FROM ref)
SELECT event_id, round(((f.x - b1.m) * (f.x - b1.m) / (b1.v * (1 + 1e-3) + 1e-8) - sc.m) / sc.sd, 6) AS z FROM frames f JOIN b1 ON b1.cell = f.t % 6 CROSS JOIN sc""")
def cross_fitted_channel(spark, sf_dir):
    """A channel's model of all normal frames, scaled by scores of normal frames under models that haven't seen their videos."""
    from ..operators import background as B

    df = frames(spark, sf_dir).withColumn("cell", (F.col("t") % 6).cast("int")).withColumn("f", F.array("x")).withColumn("channel", F.lit("frx"))
    fit = lambda own: B.finalise(B.moments(own, ["cell"], "f", 1), ["cell"], 1)
    score = lambda own, model: B.detectors(own, model, ["cell"], "f", 1)
    model, held = C.cross_fitted(df.where("y = 0"), [], "video", "t", fit, score)
    return rounded(C.z_scores(score(df, model), held, ["channel"], "frx_bayes").select("event_id", "z"), "z")


@query(f"WITH {FRAMES} SELECT video, event_id, t, round(x, 6) AS x FROM frames QUALIFY row_number() OVER (PARTITION BY video ORDER BY x DESC, t) = 1")
def most_anomalous_frame(spark, sf_dir):
    return rounded(M.first_best(frames(spark, sf_dir), ["video"], "x", ["t"]).select("video", "event_id", "t", "x"), "x")


@query(f"WITH {FRAMES} SELECT event_type, round(quantile_cont(x, 0.9), 6) AS q90, round(quantile_cont(x, 0.5), 6) AS median, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd_pop, round(stddev_samp(x), 6) AS sd_samp, count(*) FILTER (x > 4) AS active FROM frames GROUP BY 1")
def summary_statistics(spark, sf_dir):
    df = frames(spark, sf_dir).select("event_type", "x")
    rows = df.groupBy("event_type").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd_pop"), F.stddev_samp("x").alias("sd_samp"), F.count_if(F.col("x") > 4).alias("active"))
    rows = rows.join(quantiles(df, ["event_type"], "x", {"q90": 0.9, "median": 0.5}), "event_type")
    return rounded(rows, "q90", "median", "mean", "sd_pop", "sd_samp")


@query(f"WITH {FRAMES} SELECT video, count(*) AS frames, sum(y)::BIGINT AS positives, round(100 * avg(y), 6) AS percent FROM frames GROUP BY 1")
def label_tallies(spark, sf_dir):
    return rounded(M.tallies(frames(spark, sf_dir), "y", ["video"]), "percent")


assert math.isclose(1 - math.exp(-GATE) * (1 + GATE + GATE * GATE / 2), 0.9, abs_tol=1e-4)
