"""Queries of background statistics and the detectors on them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..models import BackgroundEstimator, BackgroundModel
from ..operators import background as B
from ..operators import dirichlet
from ..operators import grid as G
from ..operators import latent as L
from ..operators import mixture as X
from ..operators import predict as P
from ..operators.network import batch_features
from ..operators import temporal as T
from ..operators.autoencoder import Autoencoder
from ..operators.lookup import lookup
from ..session import folder
from .bindings import FRAMES, HEIGHT, VECTORS, WIDTH, frames, maps, rounded, table, vectors
from .evidence import auc_sql
from .register import query


def _inverse(p: str, aa: str, ab: str, bb: str) -> str:
    """SQL: the 2 x 2 inverse after the ridge, as columns p_aa, p_ab, p_bb."""
    r = f"(1e-3 * ({aa} + {bb}) / 2 + 1e-8)"
    det = f"(({aa} + {r}) * ({bb} + {r}) - {ab} * {ab})"
    return f"({bb} + {r}) / {det} AS {p}_aa, -{ab} / {det} AS {p}_ab, ({aa} + {r}) / {det} AS {p}_bb"


_BG = f"""fit AS (SELECT * FROM vectors WHERE normal),
g0 AS (SELECT avg(a) AS ga, avg(b) AS gb, covar_pop(a, a) AS gaa, covar_pop(a, b) AS gab, covar_pop(b, b) AS gbb FROM fit),
c0 AS (SELECT cell, count(*) AS n, avg(a) AS ca, avg(b) AS cb, covar_pop(a, a) AS caa, covar_pop(a, b) AS cab, covar_pop(b, b) AS cbb FROM fit GROUP BY 1),
b0 AS (SELECT *, (ca + ga) / 2 AS ba, (cb + gb) / 2 AS bb, (caa + gaa) / 2 + (ca - ga) * (ca - ga) / 4 AS baa, (cab + gab) / 2 + (ca - ga) * (cb - gb) / 4 AS bab, (cbb + gbb) / 2 + (cb - gb) * (cb - gb) / 4 AS bbb FROM c0 CROSS JOIN g0),
bg AS (SELECT *, {_inverse('pg', 'gaa', 'gab', 'gbb')}, {_inverse('pc', 'caa', 'cab', 'cbb')}, {_inverse('pb', 'baa', 'bab', 'bbb')} FROM b0)"""


def _d(p: str, a: str, b: str) -> str:
    return f"((a - {a}) * (a - {a}) * {p}_aa + 2 * (a - {a}) * (b - {b}) * {p}_ab + (b - {b}) * (b - {b}) * {p}_bb)"


_SCORED = f"scored AS (SELECT v.*, a * a + b * b AS rem, {_d('pg', 'ga', 'gb')} AS frx_global, {_d('pc', 'ca', 'cb')} AS frx_cell, {_d('pb', 'ba', 'bg.bb')} AS frx_bayes FROM vectors v JOIN bg USING (cell))"


def _background(spark, sf_dir):
    return B.finalise(B.moments(vectors(spark, sf_dir).where("normal"), ["cell"], "f", 2), ["cell"], 2)


def _scored(spark, sf_dir, nu=None):
    return B.detectors(vectors(spark, sf_dir), _background(spark, sf_dir), ["cell"], "f", 2, nu)


@query(f"""WITH {FRAMES}, s AS (SELECT *, (video % 10)::INT AS cell FROM frames), g AS (SELECT avg(x) AS gm, var_pop(x) AS gv FROM s WHERE y = 0),
c AS (SELECT cell, avg(x) AS m, var_pop(x) AS v FROM s WHERE y = 0 GROUP BY 1),
b AS (SELECT cell, (m + gm) / 2 AS m, (v + gv) / 2 + (m - gm) * (m - gm) / 4 AS v FROM c CROSS JOIN g),
d AS (SELECT s.*, (x - m) * (x - m) / (v * (1 + 1e-3) + 1e-8) AS d FROM s JOIN b USING (cell)),
f AS (SELECT *, median(d) OVER (PARTITION BY video ORDER BY t ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS sm FROM d)
SELECT event_id, video, t, y, round(d, 6) AS score, round(sm, 6) AS smoothed FROM f""")
def alarm_scores(spark, sf_dir):
    """Shrunk background by cell, distance of every frame, causal median: the live path over a table."""
    df = frames(spark, sf_dir).withColumn("cell", (F.col("video") % 10).cast("int")).withColumn("f", F.array("x"))
    bg = B.finalise(B.moments(df.where("y = 0"), ["cell"], "f", 1), ["cell"], 1)
    rows = T.causal_median(B.detectors(df, bg, ["cell"], "f", 1), ["video"], "t", "frx_bayes", "smoothed")
    return rounded(rows.select("event_id", "video", "t", "y", F.col("frx_bayes").alias("score"), "smoothed"), "score", "smoothed")


@query(f"WITH {VECTORS} SELECT cell, count(*) AS n, round(sum(a), 4) AS s_a, round(sum(b), 4) AS s_b, round(sum(a * a), 4) AS s_aa, round(sum(a * b), 4) AS s_ab, round(sum(b * b), 4) AS s_bb FROM vectors GROUP BY 1")
def cell_moments(spark, sf_dir):
    m = B.moments(vectors(spark, sf_dir), ["cell"], "f", 2)
    rows = m.select("cell", "n", F.col("s1")[0].alias("s_a"), F.col("s1")[1].alias("s_b"), F.col("s2")[0].alias("s_aa"), F.col("s2")[1].alias("s_ab"), F.col("s2")[3].alias("s_bb"))
    return rounded(rows, "s_a", "s_b", "s_aa", "s_ab", "s_bb", digits=4)


@query(f"WITH {VECTORS}, {_BG} SELECT cell, n, round(ba, 6) AS mu_a, round(bg.bb, 6) AS mu_b, round(pb_aa, 5) AS p_aa, round(pb_ab, 5) AS p_ab, round(pb_bb, 5) AS p_bb, round(-ln(pb_aa * pb_bb - pb_ab * pb_ab), 6) AS logdet FROM bg")
def shrunk_background(spark, sf_dir):
    b = _background(spark, sf_dir)
    rows = b.select("cell", "n", F.col("mu_b")[0].alias("mu_a"), F.col("mu_b")[1].alias("mu_b"), F.col("prec_b")[0].alias("p_aa"), F.col("prec_b")[1].alias("p_ab"), F.col("prec_b")[3].alias("p_bb"), F.col("logdet_b").alias("logdet"))
    return rounded(rounded(rows, "mu_a", "mu_b", "logdet"), "p_aa", "p_ab", "p_bb", digits=5)


@query(f"WITH {VECTORS}, {_BG}, {_SCORED} SELECT l_orderkey, l_linenumber, round(rem, 5) AS rem, round(frx_global, 5) AS frx_global, round(frx_cell, 5) AS frx_cell, round(frx_bayes, 5) AS frx_bayes, round(0.5 * (5 + 2) * ln(1 + frx_bayes / 3), 5) AS frx_t FROM scored")
def residual_detectors(spark, sf_dir):
    rows = _scored(spark, sf_dir, 5.0)
    return rounded(rows.select("l_orderkey", "l_linenumber", "rem", "frx_global", "frx_cell", "frx_bayes", "frx_t"), "rem", "frx_global", "frx_cell", "frx_bayes", "frx_t", digits=5)


_NU = " UNION ALL ".join(
    f"SELECT {nu}::DOUBLE AS nu, sum({math.lgamma((2 + nu) / 2) - math.lgamma(1) - math.lgamma(nu / 2) + math.log(2 / nu) + math.log(nu / (nu - 2) / 2)!r} - {(2 + nu) / 2!r} * ln(1 + 2 / {nu!r} * (frx_bayes * {nu / (nu - 2) / 2!r}))) AS l FROM scored WHERE normal AND frx_bayes > 0" for nu in B.NU_GRID
)


@query(f"WITH {VECTORS}, {_BG}, {_SCORED} SELECT nu, round(l, 2) AS loglik FROM ({_NU})")
def student_t_fit(spark, sf_dir):
    return rounded(B.fit_nu(_scored(spark, sf_dir).where("normal"), "frx_bayes", 2), "loglik", digits=2)


@query(f"""WITH {VECTORS}, {_BG}, fr AS (SELECT state, count(DISTINCT frame) AS frames FROM fit GROUP BY 1),
s0 AS (SELECT state, cell, avg(a) AS sa, avg(b) AS sb, covar_pop(a, a) AS saa, covar_pop(a, b) AS sab, covar_pop(b, b) AS sbb FROM fit GROUP BY 1, 2),
s1 AS (SELECT *, frames / (frames + 20.0::DOUBLE) AS w FROM s0 JOIN fr USING (state) JOIN b0 USING (cell)),
s2 AS (SELECT state, cell, w * sa + (1 - w) * ba AS ma, w * sb + (1 - w) * bb AS mb, w * saa + (1 - w) * baa + w * (1 - w) * (sa - ba) * (sa - ba) AS vaa,
  w * sab + (1 - w) * bab + w * (1 - w) * (sa - ba) * (sb - bb) AS vab, w * sbb + (1 - w) * bbb + w * (1 - w) * (sb - bb) * (sb - bb) AS vbb FROM s1),
s3 AS (SELECT *, {_inverse('p', 'vaa', 'vab', 'vbb')} FROM s2)
SELECT l_orderkey, l_linenumber, round({_d('p', 'ma', 'mb')}, 5) AS frx_state FROM vectors JOIN s3 USING (state, cell)""")
def state_conditioned(spark, sf_dir):
    """Statistics of each (state, cell), pulled to the cell's by how few frames the state has."""
    df = vectors(spark, sf_dir)
    own = df.where("normal")
    seen = own.groupBy("state").agg(F.count_distinct("frame").alias("frames"))
    parts = B.moments(own, ["state", "cell"], "f", 2)
    base = B.finalise(B.merge(parts, ["cell"], 2), ["cell"], 2)
    model = B.state_background(parts, seen, base, "state", "cell", 2)
    rows = lookup(df, model, ["state", "cell"]).withColumn("frx_state", B.distance(F.col("f"), F.col("mu"), F.col("prec"), 2))
    return rounded(rows.select("l_orderkey", "l_linenumber", "frx_state"), "frx_state", digits=5)


def _moments_sql(*names: str) -> str:
    """SQL: means and population covariances of a and b, called by the names given."""
    ma, mb, aa, ab, bb = names
    return f"avg(a) AS {ma}, avg(b) AS {mb}, covar_pop(a, a) AS {aa}, covar_pop(a, b) AS {ab}, covar_pop(b, b) AS {bb}"


_KAPPA = f"""v1 AS (SELECT state, cell, frame, (frame % 2)::INT AS fold, a, b FROM vectors WHERE normal),
grid AS (SELECT * FROM (VALUES {", ".join(f"({'1e300' if math.isinf(k) else k}::DOUBLE)" for k in B.KAPPA_GRID)}) g(kappa)),
frm AS (SELECT fold, state, count(DISTINCT frame) AS frames FROM v1 GROUP BY 1, 2),
gl AS (SELECT fold, {_moments_sql("ga", "gb", "gaa", "gab", "gbb")} FROM v1 GROUP BY 1),
cl AS (SELECT fold, cell, {_moments_sql("ca", "cb", "caa", "cab", "cbb")} FROM v1 GROUP BY 1, 2),
bs AS (SELECT fold, cell, (ca + ga) / 2 AS a0, (cb + gb) / 2 AS b0, (caa + gaa) / 2 + (ca - ga) * (ca - ga) / 4 AS aa0, (cab + gab) / 2 + (ca - ga) * (cb - gb) / 4 AS ab0, (cbb + gbb) / 2 + (cb - gb) * (cb - gb) / 4 AS bb0 FROM cl JOIN gl USING (fold)),
st AS (SELECT fold, state, cell, count(*) AS n, {_moments_sql("ma", "mb", "saa", "sab", "sbb")} FROM v1 GROUP BY 1, 2, 3),
wt AS (SELECT *, CASE WHEN kappa > 1e100 THEN 0 ELSE frames / (frames + kappa) END AS w FROM st JOIN frm USING (fold, state) JOIN bs USING (fold, cell) CROSS JOIN grid),
md AS (SELECT kappa, fold, state, cell, w * ma + (1 - w) * a0 AS mua, w * mb + (1 - w) * b0 AS mub, w * saa + (1 - w) * aa0 + w * (1 - w) * (ma - a0) * (ma - a0) AS vaa,
  w * sab + (1 - w) * ab0 + w * (1 - w) * (ma - a0) * (mb - b0) AS vab, w * sbb + (1 - w) * bb0 + w * (1 - w) * (mb - b0) * (mb - b0) AS vbb FROM wt),
pr AS (SELECT *, {_inverse('p', 'vaa', 'vab', 'vbb')} FROM md)"""


@query(f"""WITH {VECTORS}, {_KAPPA}
SELECT CASE WHEN kappa > 1e100 THEN 'inf' ELSE kappa::INT::VARCHAR END AS kappa0, round(sum(0.5 * h.n * (ln(p_aa * p_bb - p_ab * p_ab)
  - p_aa * (saa + (ma - mua) * (ma - mua)) - 2 * p_ab * (sab + (ma - mua) * (mb - mub)) - p_bb * (sbb + (mb - mub) * (mb - mub)))), 2) AS loglik
FROM pr JOIN st h ON h.fold = 1 - pr.fold AND h.state = pr.state AND h.cell = pr.cell GROUP BY 1""")
def prior_strength(spark, sf_dir):
    """Held-out likelihood of each prior strength over two folds of frames, from sums of vectors of two components."""
    df = vectors(spark, sf_dir).where("normal").withColumn("fold", (F.col("frame") % 2).cast("int"))
    seen = df.groupBy("fold", "state").agg(F.count_distinct("frame").alias("frames"))
    found = B.choose_kappa0(B.moments(df, ["fold", "state", "cell"], "f", 2), seen, "fold", "state", "cell", 2)
    name = F.when(F.col("kappa0") == float("inf"), "inf").otherwise(F.col("kappa0").cast("int").cast("string"))
    return rounded(found.select(name.alias("kappa0"), "loglik"), "loglik", digits=2)


@query(f"WITH {VECTORS}, {_BG}, {_SCORED}, s AS (SELECT frx_bayes, round(frx_bayes, 9) AS s, (NOT normal)::INT AS y FROM scored) {auc_sql('s')}")
def detector_auc(spark, sf_dir):
    from ..operators.metrics import auc

    rows = _scored(spark, sf_dir).select(F.round("frx_bayes", 9).alias("s"), (~F.col("normal")).cast("int").alias("y"))
    return rounded(auc(rows, "s", "y"), "auc")


@query()
def deep_feature_rx(spark, sf_dir):
    """Distances of whole embedding vectors from their label's shrunk background; tested against NumPy."""
    df = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("f"))
    bg = B.finalise(B.moments(df, ["label"], "f", 64), ["label"], 64)
    return rounded(B.detectors(df, bg, ["label"], "f", 64).select("vec_id", "rem", "frx_bayes"), "rem", "frx_bayes")


@query()
def universal_mixture(spark, sf_dir):
    """A universal mixture adapted to each cell; tested against NumPy given the fitted mixture."""
    df = vectors(spark, sf_dir).where("normal")
    return X.universal_background(df, "cell", "f", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "ubm")


def placed_codes(spark, sf_dir):
    """vec_id, embedding and a position on a grid of 12 by 10, by id."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return rows.select("vec_id", "embedding", (F.col("vec_id") % 10 / 9.0).alias("px"), (F.floor(F.col("vec_id") / 10) % 12 / 11.0).alias("py"))


@query()
def code_mixture(spark, sf_dir):
    """Negative log densities of reduced embedding codes with their positions, under a Dirichlet-process mixture of 20 sticks; tested against NumPy."""
    return L.code_mixture(placed_codes(spark, sf_dir), "embedding", ["vec_id"], position=["px", "py"]).select("vec_id", "bgmm")


@query()
def active_components(spark, sf_dir):
    """Components of a Dirichlet-process mixture of residual vectors, and which of them the rows need; tested against NumPy."""
    df = vectors(spark, sf_dir).where("normal")
    return L.components(dirichlet.fit(df, "f", ["l_orderkey", "l_linenumber"], 6).mixture(), spark)


def month_views(spark, sf_dir):
    """frame, f: coarse views of the months' maps."""
    view = G.coarse_view(G.dense(maps(spark, sf_dir), ["frame"], "v", HEIGHT, WIDTH), ["frame"], "v", HEIGHT, WIDTH, 4)
    return view.groupBy("frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda s: s["mean"]).alias("f"))


@query()
def scene_states(spark, sf_dir):
    """States of months from coarse views of their maps, six at most; tested against NumPy."""
    df = month_views(spark, sf_dir)
    return L.scene_states(df, df.where("frame % 2 = 0"), "f", ["frame"]).select("frame", "state")


@query()
def nonlinear_residual(spark, sf_dir):
    """What a trained network of tanh units doesn't rebuild of embeddings; tested against NumPy."""
    df = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("f"))
    model = Autoencoder(8).fit(df, "f", 64, ["vec_id"])
    error = F.aggregate("r", F.lit(0.0), lambda a, x: a + F.abs(x)) / 64
    return model.residuals(df, "f", "r").select("vec_id", error.alias("error"))


@query(f"WITH {VECTORS}, {_BG}, {_SCORED} SELECT l_orderkey, l_linenumber, round(frx_global, 6) AS frx_global, round(frx_cell, 6) AS frx_cell, round(frx_bayes, 6) AS frx_bayes FROM scored")
def saved_background(spark, sf_dir):
    """A background learned, saved, loaded and only then used."""
    path = folder(spark, "model")
    BackgroundEstimator(cellCol="cell", featuresCol="f", dim=2).fit(vectors(spark, sf_dir).where("normal")).save(path)
    names = ["frx_global", "frx_cell", "frx_bayes"]
    return rounded(BackgroundModel.load(path).transform(vectors(spark, sf_dir)).select("l_orderkey", "l_linenumber", *names), *names)


@query(f"""WITH {FRAMES}, l AS (SELECT event_id, y, (video % 10)::INT AS cell, x, lag(x, 1) OVER w AS a, lag(x, 2) OVER w AS b FROM frames WINDOW w AS (PARTITION BY video ORDER BY t)),
r AS (SELECT * FROM l WHERE b IS NOT NULL),
c AS (SELECT cell, avg(a) AS ma, avg(b) AS mb, avg(x) AS mx, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, x) AS ax, covar_pop(b, x) AS bx FROM r WHERE y = 0 GROUP BY 1),
p AS (SELECT *, {_inverse('p', 'aa', 'ab', 'bb')} FROM c), q AS (SELECT *, p_aa * ax + p_ab * bx AS wa, p_ab * ax + p_bb * bx AS wb FROM p)
SELECT event_id, round(x - mx - wa * (a - ma) - wb * (b - mb), 6) AS residual FROM r JOIN q USING (cell)""")
def predictive_residual(spark, sf_dir):
    """Frames minus what the two frames before predict, by a ridge regression for each cell."""
    df = frames(spark, sf_dir).withColumn("cell", (F.col("video") % 10).cast("int"))
    return rounded(P.predictive_residual(df, "y = 0", ["video"], "t", "cell", "x").select("event_id", "residual"), "residual")


@query("SELECT vec_id, round(list_sum([x::DOUBLE FOR x IN embedding]), 5) AS total, round(list_sum([x::DOUBLE * x FOR x IN embedding]), 5) AS energy FROM embeddings WHERE embedding IS NOT NULL")
def network_features(spark, sf_dir):
    """Features by a function of batches, as a frozen network would give them."""
    load = lambda: lambda x: np.stack([x.sum(1), (x * x).sum(1)], 1)
    rows = batch_features(table(spark, sf_dir, "embeddings").where("embedding is not null"), "embedding", load, shape=[64])
    return rounded(rows.select("vec_id", F.col("f")[0].alias("total"), F.col("f")[1].alias("energy")), "total", "energy", digits=5)
