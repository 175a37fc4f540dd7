"""Queries over cell maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as G
from .bindings import HEIGHT, MAPS, WIDTH, maps, rounded, table
from .register import query

_F = ["frame"]


def _windows(size: int, height: int = HEIGHT, width: int = WIDTH, source: str = "dense") -> str:
    more, back = 1 - size % 2, size // 2
    return f"""win AS (
  SELECT fr.frame, p.y, q.x, coalesce(sum(d.v), 0) AS s
  FROM fr CROSS JOIN range(0, {height + more}) p(y) CROSS JOIN range(0, {width + more}) q(x)
  LEFT JOIN {source} d ON d.frame = fr.frame AND d.y BETWEEN p.y - {back} AND p.y + {size - 1 - back} AND d.x BETWEEN q.x - {back} AND q.x + {size - 1 - back}
  GROUP BY 1, 2, 3)"""


@query(f"WITH {MAPS}, {_windows(4)} SELECT frame, round(max(s) / 16, 6) AS score FROM win GROUP BY frame")
def frame_score_even(spark, sf_dir):
    return rounded(G.frame_score(maps(spark, sf_dir), _F, "v", HEIGHT, WIDTH, 4), "score")


@query(f"WITH {MAPS}, {_windows(3)} SELECT frame, round(max(s) / 9, 6) AS score FROM win GROUP BY frame")
def frame_score_odd(spark, sf_dir):
    return rounded(G.frame_score(maps(spark, sf_dir), _F, "v", HEIGHT, WIDTH, 3), "score")


@query(f"WITH {MAPS}, roi AS (SELECT frame, y, x, v * (CASE WHEN (y + x) % 3 = 0 THEN 0 ELSE 1 END) AS v FROM dense), {_windows(4, source='roi')} SELECT frame, round(max(s) / 16, 6) AS score FROM win GROUP BY frame")
def frame_score_roi(spark, sf_dir):
    roi = spark.createDataFrame([(y, x, int((y + x) % 3 != 0)) for y in range(HEIGHT) for x in range(WIDTH)], "y int, x int, m int")
    return rounded(G.frame_score(maps(spark, sf_dir), _F, "v", HEIGHT, WIDTH, 4, roi=roi), "score")


@query(f"WITH {MAPS}, {_windows(6)} SELECT frame, round(max(s), 6) AS score FROM win GROUP BY frame")
def scan_statistic(spark, sf_dir):
    return rounded(G.scan_statistic(maps(spark, sf_dir), _F, "v", HEIGHT, WIDTH), "score")


_CLOSED = """dil AS (SELECT a.frame, a.y, a.x, a.v, max(b.v) AS m FROM dense a JOIN dense b ON a.frame = b.frame AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL),
closed AS (SELECT a.frame, a.y, a.x, a.v, min(b.m) AS c FROM dil a JOIN dil b ON a.frame = b.frame AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL)"""


@query(f"WITH {MAPS}, {_CLOSED} SELECT frame, y, x, round(c, 6) AS c FROM closed")
def closing(spark, sf_dir):
    rows = G.closing(G.dense(maps(spark, sf_dir), _F, "v", HEIGHT, WIDTH), _F, "v", "c")
    return rounded(rows.select("frame", "y", "x", "c"), "c")


@query(f"WITH {MAPS} SELECT frame, (y // 5 * 2 + x // 5)::INT AS cell_id, round(sum(v) / 25, 6) AS sum_mean, round(avg(v), 6) AS valid_mean, round(max(v), 6) AS largest FROM dense GROUP BY 1, 2")
def cell_pooling(spark, sf_dir):
    return rounded(G.pool_cells(G.dense(maps(spark, sf_dir), _F, "v", HEIGHT, WIDTH), _F, "v", 5, WIDTH), "sum_mean", "valid_mean", "largest")


@query(f"WITH {MAPS} SELECT frame, (y // 4 * 2 + x // 4)::INT AS i, round(avg(v), 6) AS mean FROM dense WHERE y < 12 AND x < 8 GROUP BY 1, 2")
def coarse_view(spark, sf_dir):
    return rounded(G.coarse_view(G.dense(maps(spark, sf_dir), _F, "v", HEIGHT, WIDTH), _F, "v", HEIGHT, WIDTH, 4), "mean")


@query(f"""WITH {MAPS}, cells AS (SELECT frame, (y // 4)::INT AS cy, (x // 4)::INT AS cx, max(v) AS v FROM dense GROUP BY 1, 2, 3),
up AS (SELECT d.frame, d.y, d.x, c.v FROM dense d JOIN cells c ON c.frame = d.frame AND c.cy = d.y // 4 AND c.cx = d.x // 4), {_windows(4, source='up')}
SELECT frame, round(max(s) / 16, 6) AS score FROM win GROUP BY frame""")
def upsampled_score(spark, sf_dir):
    cells = G.pool_cells(G.dense(maps(spark, sf_dir), _F, "v", HEIGHT, WIDTH), _F, "v", 4, WIDTH).select("frame", "cell_id", F.col("largest").alias("v"))
    return rounded(G.frame_score(G.upsample(cells, _F, "v", 3, 3, HEIGHT, WIDTH), _F, "v", HEIGHT, WIDTH, 4), "score")


_PATCHES = f"""starts AS (SELECT * FROM (VALUES (0), (2), (4), (6), (8)) p(py) CROSS JOIN (VALUES (0), (2), (4), (6)) q(px)),
patches AS (SELECT d.frame, py, px, avg(v) AS v FROM dense d JOIN starts ON d.y BETWEEN py AND py + 3 AND d.x BETWEEN px AND px + 3 GROUP BY 1, 2, 3)"""


@query(f"WITH {MAPS}, {_PATCHES} SELECT d.frame, d.y, d.x, round(avg(p.v), 6) AS v FROM dense d JOIN patches p ON p.frame = d.frame AND d.y BETWEEN py AND py + 3 AND d.x BETWEEN px AND px + 3 GROUP BY 1, 2, 3")
def patch_overlap_mean(spark, sf_dir):
    patches = G.extract_patches(G.dense(maps(spark, sf_dir), _F, "v", HEIGHT, WIDTH), _F, "v", HEIGHT, WIDTH, 4, 2)
    mean = patches.select("frame", "py", "px", (F.aggregate("values", F.lit(0.0), lambda a, v: a + v) / 16).alias("v"))
    return rounded(G.patches_to_map(mean, _F, "v", HEIGHT, WIDTH, 4, 2), "v")


@query(f"""WITH {MAPS}, e AS (SELECT frame, y, x, v AS r, v * v AS v FROM dense),
dil AS (SELECT a.frame, a.y, a.x, a.r, max(b.v) AS m FROM e a JOIN e b ON a.frame = b.frame AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL),
cl AS (SELECT a.frame, a.y, a.x, a.r, 1 / (min(b.m) + 1e-6) AS w FROM dil a JOIN dil b ON a.frame = b.frame AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL),
m AS (SELECT frame, sum(w * r) / sum(w) AS m FROM cl GROUP BY 1),
v AS (SELECT cl.frame, sum(w * (r - m) * (r - m)) / sum(w) AS v FROM cl JOIN m USING (frame) GROUP BY 1)
SELECT cl.frame, y, x, round((r - m) * (r - m) / (v * (1 + 1e-3) + 1e-8), 5) AS wrx FROM cl JOIN m USING (frame) JOIN v USING (frame)""")
def weighted_rx(spark, sf_dir):
    from ..operators.background import weighted_rx as rx

    rows = G.dense(maps(spark, sf_dir), _F, "v", HEIGHT, WIDTH).withColumn("e", F.col("v") * F.col("v"))
    return rounded(rx(G.closing(rows, _F, "e", "c"), _F, "v", "c").select("frame", "y", "x", "wrx"), "wrx", digits=5)


_WRX = """e AS (SELECT frame, y, x, v AS r, v * v AS v FROM dense),
dil AS (SELECT a.frame, a.y, a.x, a.r, max(b.v) AS m FROM e a JOIN e b ON a.frame = b.frame AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL),
cl AS (SELECT a.frame, a.y, a.x, a.r, 1 / (min(b.m) + 1e-6) AS w FROM dil a JOIN dil b ON a.frame = b.frame AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL),
wm AS (SELECT frame, sum(w * r) / sum(w) AS m FROM cl GROUP BY 1),
wv AS (SELECT cl.frame, sum(w * (r - m) * (r - m)) / sum(w) AS v FROM cl JOIN wm USING (frame) GROUP BY 1)"""

_DET = f"""{_WRX}, cellv AS (SELECT *, (y // 4 * 3 + x // 4)::INT AS cell FROM dense), nrm AS (SELECT * FROM cellv WHERE frame % 2 = 0),
gg AS (SELECT avg(v) AS gm, var_pop(v) AS gv FROM nrm), cc AS (SELECT cell, avg(v) AS m, var_pop(v) AS cv FROM nrm GROUP BY 1),
bb AS (SELECT *, (m + gm) / 2 AS bm, (cv + gv) / 2 + (m - gm) * (m - gm) / 4 AS bv FROM cc CROSS JOIN gg),
dd AS (SELECT c.frame, y, x, c.v * c.v AS rem, (c.v - gm) * (c.v - gm) / (gv * 1.001::DOUBLE + 1e-8) AS frx_global, (c.v - m) * (c.v - m) / (cv * 1.001::DOUBLE + 1e-8) AS frx_cell,
  (c.v - bm) * (c.v - bm) / (bv * 1.001::DOUBLE + 1e-8) AS frx_bayes FROM cellv c JOIN bb USING (cell)),
lng AS (SELECT frame, y, x, 'rem' AS detector, rem AS v FROM dd UNION ALL SELECT frame, y, x, 'frx_global', frx_global FROM dd UNION ALL SELECT frame, y, x, 'frx_cell', frx_cell FROM dd
  UNION ALL SELECT frame, y, x, 'frx_bayes', frx_bayes FROM dd UNION ALL SELECT frame, y, x, 'frx_t', 0.5 * (5 + 1) * ln(1 + frx_bayes / 3) FROM dd
  UNION ALL SELECT cl.frame, y, x, 'wrx', (r - m) * (r - m) / (v * (1 + 1e-3) + 1e-8) FROM cl JOIN wm USING (frame) JOIN wv USING (frame)),
ws AS (SELECT fr.frame, t.detector, p.y, q.x, coalesce(sum(d.v), 0) AS s FROM fr CROSS JOIN (SELECT DISTINCT detector FROM lng) t CROSS JOIN range(0, 13) p(y) CROSS JOIN range(0, 11) q(x)
  LEFT JOIN lng d ON d.frame = fr.frame AND d.detector = t.detector AND d.y BETWEEN p.y - 2 AND p.y + 1 AND d.x BETWEEN q.x - 2 AND q.x + 1 GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {MAPS}, {_DET} SELECT frame, detector, round(max(s) / 16, 4) AS score FROM ws GROUP BY 1, 2")
def frame_detectors(spark, sf_dir):
    """Every residual detector's frame score."""
    from ..operators.bundle import score_frames

    m = G.dense(maps(spark, sf_dir), _F, "v", HEIGHT, WIDTH)
    rows = score_frames(m, m.where("frame % 2 = 0"), _F, "v", HEIGHT, WIDTH, 4, 4, 5.0)
    return rounded(rows, "score", digits=4)


def _pair_sql() -> str:
    from .backgrounds import _d, _inverse

    names = ("rem", "frx_global", "frx_cell", "frx_bayes", "wrx")
    long = " UNION ALL ".join(f"SELECT frame, y, x, '{n}' AS detector, {n} AS v FROM dd" for n in names) + " UNION ALL SELECT frame, y, x, 'frx_t', 0.5 * (5 + 2) * ln(1 + frx_bayes / 3) FROM dd"
    return f"""pairs AS (SELECT (year(l_shipdate) * 12 + month(l_shipdate))::INT AS frame, (l_suppkey % 12)::INT AS y, (l_partkey % 10)::INT AS x, sum(l_quantity - 25.5::DOUBLE) AS a, sum(l_discount * 100 - 5) AS b FROM lineitem GROUP BY 1, 2, 3),
fr AS (SELECT DISTINCT frame FROM pairs),
dense AS (SELECT fr.frame, ys.y::INT AS y, xs.x::INT AS x, coalesce(p.a, 0)::DOUBLE AS a, coalesce(p.b, 0)::DOUBLE AS b, (ys.y // 4 * 3 + xs.x // 4)::INT AS cell FROM fr CROSS JOIN range(0, 12) ys(y) CROSS JOIN range(0, 10) xs(x)
  LEFT JOIN pairs p ON p.frame = fr.frame AND p.y = ys.y AND p.x = xs.x),
e AS (SELECT *, a * a + b * b AS v FROM dense),
dil AS (SELECT a.frame, a.y, a.x, max(b.v) AS m FROM e a JOIN e b ON a.frame = b.frame AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL),
cl AS (SELECT a.frame, a.y, a.x, 1 / (min(b.m) + 1e-6) AS w FROM dil a JOIN dil b ON a.frame = b.frame AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL),
wm AS (SELECT frame, sum(w * a) / sum(w) AS wa, sum(w * b) / sum(w) AS wb FROM cl JOIN e USING (frame, y, x) GROUP BY 1),
wv AS (SELECT frame, sum(w * (a - wa) * (a - wa)) / sum(w) AS waa, sum(w * (a - wa) * (b - wb)) / sum(w) AS wab, sum(w * (b - wb) * (b - wb)) / sum(w) AS wbb FROM cl JOIN e USING (frame, y, x) JOIN wm USING (frame) GROUP BY 1),
wp AS (SELECT *, {_inverse('pw', 'waa', 'wab', 'wbb')} FROM wv JOIN wm USING (frame)),
fit AS (SELECT * FROM dense WHERE frame % 2 = 0),
g0 AS (SELECT avg(a) AS ga, avg(b) AS gb, covar_pop(a, a) AS gaa, covar_pop(a, b) AS gab, covar_pop(b, b) AS gbb FROM fit),
c0 AS (SELECT cell, avg(a) AS ca, avg(b) AS cb, covar_pop(a, a) AS caa, covar_pop(a, b) AS cab, covar_pop(b, b) AS cbb FROM fit GROUP BY 1),
b0 AS (SELECT *, (ca + ga) / 2 AS ba, (cb + gb) / 2 AS bm, (caa + gaa) / 2 + (ca - ga) * (ca - ga) / 4 AS baa, (cab + gab) / 2 + (ca - ga) * (cb - gb) / 4 AS bab, (cbb + gbb) / 2 + (cb - gb) * (cb - gb) / 4 AS bbb FROM c0 CROSS JOIN g0),
bg AS (SELECT *, {_inverse('pg', 'gaa', 'gab', 'gbb')}, {_inverse('pc', 'caa', 'cab', 'cbb')}, {_inverse('pb', 'baa', 'bab', 'bbb')} FROM b0),
dd AS (SELECT frame, y, x, v AS rem, {_d('pg', 'ga', 'gb')} AS frx_global, {_d('pc', 'ca', 'cb')} AS frx_cell, {_d('pb', 'ba', 'bm')} AS frx_bayes, {_d('pw', 'wa', 'wb')} AS wrx FROM e JOIN bg USING (cell) JOIN wp USING (frame)),
lng AS ({long}),
ws AS (SELECT fr.frame, t.detector, p.y, q.x, coalesce(sum(d.v), 0) AS s FROM fr CROSS JOIN (SELECT DISTINCT detector FROM lng) t CROSS JOIN range(0, 13) p(y) CROSS JOIN range(0, 11) q(x)
  LEFT JOIN lng d ON d.frame = fr.frame AND d.detector = t.detector AND d.y BETWEEN p.y - 2 AND p.y + 1 AND d.x BETWEEN q.x - 2 AND q.x + 1 GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {_pair_sql()} SELECT frame, detector, round(max(s) / 16, 4) AS score FROM ws GROUP BY 1, 2")
def pair_detectors(spark, sf_dir):
    """Every residual detector's frame score for residuals of two components: quantities and discounts."""
    from ..operators.bundle import score_frames

    line = table(spark, sf_dir, "lineitem").select((F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("frame"), (F.col("l_suppkey") % HEIGHT).cast("int").alias("y"), (F.col("l_partkey") % WIDTH).cast("int").alias("x"), (F.col("l_quantity") - 25.5).alias("a"), (F.col("l_discount") * 100 - 5).alias("b"))
    sums = line.groupBy("frame", "y", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    m = G.dense(sums, _F, "a", HEIGHT, WIDTH).join(sums.select("frame", "y", "x", "b"), ["frame", "y", "x"], "left")
    m = m.select("frame", "y", "x", F.array("a", F.coalesce("b", F.lit(0.0))).alias("f"))
    return rounded(score_frames(m, m.where("frame % 2 = 0"), _F, "f", HEIGHT, WIDTH, 4, 4, 5.0, dim=2), "score", digits=4)


@query()
def all_detectors(spark, sf_dir):
    """Frame scores of all detectors: of residuals, of the scene's state, of codes, and fused; tested against NumPy."""
    from ..operators.bundle import all_scores

    m = G.dense(maps(spark, sf_dir), _F, "v", HEIGHT, WIDTH)
    normal = m.select("frame").distinct().where("frame % 2 = 0")
    return all_scores(m, normal, _F, "v", HEIGHT, WIDTH, 4, 4, 4, 4, 2, nu=5.0, code=6)


@query()
def patch_residual(spark, sf_dir):
    """Residuals of overlapping patches from a linear reconstruction; tested against NumPy."""
    from ..operators.reconstruct import LinearReconstructor, overlap_residual

    m = G.dense(maps(spark, sf_dir), _F, "v", HEIGHT, WIDTH)
    patches = G.extract_patches(m, _F, "v", HEIGHT, WIDTH, 4, 2)
    model = LinearReconstructor(6).fit(patches.where("frame % 2 = 0"), "values", 16)
    return rounded(overlap_residual(model.residuals(patches, "values", "r"), "r", _F, HEIGHT, WIDTH, 4), "r")
