"""Queries of projections, sampling, joins and text records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judge as J
from ..operators import ngrams as N
from ..operators import metrics as M
from ..operators import relational as R
from ..operators import sampling as S
from ..operators.ranking import quantile
from ..sources.frames import decimate, frame_labels, label_ranges
from .bindings import FRAMES, frames, rounded, table
from .register import query


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / 127.5::DOUBLE - 1, 6) AS u FROM lineitem")
def unit_scaling(spark, sf_dir):
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 127.5 - 1).alias("u")), "u")


@query(f"WITH {FRAMES}, m AS (SELECT video, avg(x) AS m FROM frames GROUP BY 1) SELECT event_id, round(x - m, 6) AS residual FROM frames JOIN m USING (video)")
def residual_projection(spark, sf_dir):
    """A frame minus what a (here constant) model of its camera predicts."""
    df = frames(spark, sf_dir)
    model = df.groupBy("video").agg(F.avg("x").alias("m"))
    return rounded(df.join(model, "video").select("event_id", (F.col("x") - F.col("m")).alias("residual")), "residual")


@query(f"WITH {FRAMES} SELECT event_id, video, t FROM frames WHERE t >= 3 AND (t - 3) % 4 = 0")
def stride_sampling(spark, sf_dir):
    return S.stride(frames(spark, sf_dir), "t", 3, 4).select("event_id", "video", "t")


@query(f"WITH {FRAMES} SELECT event_id FROM frames ORDER BY md5('0:' || event_id), event_id LIMIT 500")
def capped_sample(spark, sf_dir):
    return S.cap(frames(spark, sf_dir), ["event_id"], 500).select("event_id")


@query(f"WITH {FRAMES} SELECT event_id, video FROM frames QUALIFY row_number() OVER (PARTITION BY video ORDER BY md5('0:' || event_id), event_id) <= 5")
def capped_per_series(spark, sf_dir):
    return S.cap(frames(spark, sf_dir), ["event_id"], 5, keys=["video"]).select("event_id", "video")


@query(f"WITH {FRAMES} SELECT event_id FROM frames WHERE t >= 6")
def eligible_clip_starts(spark, sf_dir):
    return S.clip_starts(frames(spark, sf_dir), ["video"], "t", 4, 2).select("event_id")


@query(f"""WITH {FRAMES}, m AS (SELECT event_id, round(stddev_samp(x) OVER (PARTITION BY video ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 9) AS motion, t FROM frames),
c AS (SELECT event_id, motion FROM m WHERE t >= 3 ORDER BY md5('0:' || event_id), event_id LIMIT 128),
top AS (SELECT event_id FROM c ORDER BY motion DESC, event_id LIMIT 32),
rest AS (SELECT event_id FROM c WHERE event_id NOT IN (SELECT event_id FROM top) ORDER BY md5('1:' || event_id), event_id LIMIT 32)
SELECT event_id, 'motion' AS pick FROM top UNION ALL SELECT event_id, 'random' FROM rest""")
def motion_stratified_batch(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("video").orderBy("t").rowsBetween(-3, 0)
    df = frames(spark, sf_dir).withColumn("motion", F.round(F.stddev_samp("x").over(w), 9)).where("t >= 3")
    return S.motion_batch(df.select("event_id", "motion"), ["event_id"], "motion", 64, 0.5).select("event_id", "pick")


@query("SELECT vec_id, round(embedding[4]::DOUBLE, 6) AS e0, round(embedding[1]::DOUBLE, 6) AS e1, round(embedding[61]::DOUBLE, 6) AS e2 FROM embeddings")
def dimension_subset(spark, sf_dir):
    df = S.dimensions(table(spark, sf_dir, "embeddings"), "embedding", [3, 0, 60], "e")
    return rounded(df.select("vec_id", *(F.col("e")[i].cast("double").alias(f"e{i}") for i in range(3))), "e0", "e1", "e2")


@query(f"""WITH {FRAMES}, v AS (SELECT video, count(*) AS n, row_number() OVER (ORDER BY video) - 1 AS v FROM frames GROUP BY 1),
p AS (SELECT i AS pick, (i % (SELECT count(*) FROM v))::BIGINT AS v FROM range(0, 64) r(i))
SELECT pick, video, f.t::INT AS t, event_id FROM p JOIN v USING (v) JOIN frames f USING (video) WHERE f.t = (pick * 7919) % n""")
def spread_frames(spark, sf_dir):
    return S.spread(frames(spark, sf_dir).withColumn("t", F.col("t").cast("int")), "video", "t", 64).select("pick", "video", "t", "event_id")


@query(f"WITH {FRAMES}, l AS (SELECT video, t, y FROM frames WHERE t < 40) SELECT f.event_id, l.y FROM frames f JOIN l USING (video, t)")
def labelled_frames(spark, sf_dir):
    df = frames(spark, sf_dir)
    return R.labelled(df.select("event_id", "video", "t"), df.where("t < 40").select("video", "t", "y"), ["video", "t"]).select("event_id", "y")


@query(f"WITH {FRAMES} SELECT video, count(*) AS frames, count(*) FILTER (t < 40) AS labels FROM frames GROUP BY 1 HAVING count(*) <> count(*) FILTER (t < 40)")
def length_mismatches(spark, sf_dir):
    df = frames(spark, sf_dir)
    return R.length_mismatches(df, df.where("t < 40"), "video")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def unlabelled_series(spark, sf_dir):
    """Customers as videos, urgent orders as their labels."""
    return R.unlabelled(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def available_scores(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return R.available(table(spark, sf_dir, "orders"), wanted, "o_custkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def missing_outputs(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.missing_outputs(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query()
def fingerprints(spark, sf_dir):
    """CRC-32 of whole pages; tested against zlib."""
    return R.fingerprint(table(spark, sf_dir, "pages"), ["page_id"], "html")


@query("SELECT page_id FROM pages WHERE page_id % 3 = 0 OR (page_id % 3 = 1 AND page_id % 2 = 0)")
def stale_features(spark, sf_dir):
    """A cache that lacks every third page, has others' fingerprints, and for the rest has the same or none recorded."""
    own = R.fingerprint(table(spark, sf_dir, "pages"), ["page_id"], "html")
    third = F.col("page_id") % 3
    cached = own.where(third != 0).withColumn("fp", F.when(third == 2, F.lit(None)).when(F.col("page_id") % 2 == 0, F.lit("old")).otherwise(F.col("fp")))
    return R.stale(own, cached, ["page_id"]).select("page_id")


_RANGES = "'gt_frame = [' || (t + 1) || ':' || (t + 3) || ', ' || (t + 8) || ':' || (t + 8) || '];'"


@query(f"WITH {FRAMES}, r AS (SELECT video, t AS a, t + 2 AS b FROM frames WHERE t % 20 = 5 UNION ALL SELECT video, t + 7, t + 7 FROM frames WHERE t % 20 = 5) SELECT event_id, (EXISTS (SELECT 1 FROM r WHERE r.video = f.video AND f.t BETWEEN a AND b))::INT AS y FROM frames f")
def label_range_parse(spark, sf_dir):
    df = frames(spark, sf_dir).withColumn("t", F.col("t").cast("int"))
    text = df.where("t % 20 = 5").select("video", F.format_string("gt_frame = [%d:%d, %d:%d];", F.col("t") + 1, F.col("t") + 3, F.col("t") + 8, F.col("t") + 8).alias("text"))
    return frame_labels(df.select("event_id", "video", "t"), label_ranges(text, "text", ["video"]), ["video"], "t").select("event_id", "y")


@query(f"WITH {FRAMES} SELECT event_id FROM frames WHERE t % 3 = 0")
def decimated_frames(spark, sf_dir):
    return decimate(frames(spark, sf_dir), 30.0, 10.0).select("event_id")


@query("""WITH s AS (SELECT 'R' || r_regionkey AS scene, n_nationkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'R' ELSE 'S' END AS kind, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE c_acctbal END AS v FROM s)
SELECT coalesce(kind, 'MEAN') AS kind, round(avg(v), 4) AS mean FROM m GROUP BY GROUPING SETS ((kind), ())""")
def prefix_means(spark, sf_dir):
    """Means over all scenes, and by the kind that their name begins with; missing (NaN) values don't count."""
    c = table(spark, sf_dir, "customer").select((F.when(F.col("c_nationkey") % 2 == 0, "R").otherwise("S")).alias("kind"), F.when(F.col("c_nationkey") % 7 == 0, float("nan")).otherwise(F.col("c_acctbal")).alias("v"))
    rows = c.withColumn("v", F.nanvl("v", F.lit(None).cast("double"))).rollup("kind").agg(F.avg("v").alias("mean"))
    return rounded(rows.select(F.coalesce("kind", F.lit("MEAN")).alias("kind"), "mean"), "mean", digits=4)


@query("""WITH r AS (SELECT o_orderpriority AS run, o_orderstatus AS post, c_mktsegment AS det, round(avg(o_totalprice), 6) AS auc FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)
SELECT run, post, det, auc FROM r QUALIFY row_number() OVER (PARTITION BY run, post ORDER BY auc DESC, det) = 1""")
def best_per_run(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    r = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("post"), F.col("c_mktsegment").alias("det")).agg(F.round(F.avg("o_totalprice"), 6).alias("auc"))
    return M.first_best(r, ["run", "post"], "auc", ["det"]).select("run", "post", "det", "auc")


@query(f"WITH {FRAMES} SELECT event_type, round(quantile_cont(gap, 0.5), 6) AS median_gap FROM (SELECT event_type, date_diff('microsecond', lag(ts) OVER (PARTITION BY video ORDER BY t), ts) / 1e6::DOUBLE AS gap FROM frames) WHERE gap IS NOT NULL GROUP BY 1")
def median_latency(spark, sf_dir):
    from pyspark.sql import Window

    df = frames(spark, sf_dir)
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(Window.partitionBy("video").orderBy("t")), F.col("ts")) / 1e6
    return rounded(quantile(df.select("event_type", gap.alias("gap")), ["event_type"], "gap", 0.5, "median_gap"), "median_gap")


_TEXT = "list_distinct(regexp_extract_all(lower(text), '[a-z]+'))"


@query(f"""WITH n AS (SELECT term, count(*) AS n FROM (SELECT unnest({_TEXT}) AS term FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 0) GROUP BY 1 HAVING count(*) >= 2),
t AS (SELECT item_id, unnest({_TEXT}) AS term FROM benchmark),
c AS (SELECT item_id, count(*) AS terms, count(*) FILTER (n.term IS NULL) AS unknown FROM t LEFT JOIN n USING (term) GROUP BY 1)
SELECT b.item_id, coalesce(terms, 0) AS terms, coalesce(unknown, 0) AS unknown, round(ln((coalesce(unknown, 0) + 0.5::DOUBLE) / (coalesce(terms, 0) - coalesce(unknown, 0) + 0.5::DOUBLE)), 6) AS score FROM benchmark b LEFT JOIN c USING (item_id)""")
def unknown_words(spark, sf_dir):
    """Records judged by how many of their words normal records don't show."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id"), "doc_id")
    normal = J.normal_terms(docs, ["doc_id"], "text")
    return rounded(J.log_odds(table(spark, sf_dir, "benchmark"), normal, ["item_id"], "text"), "score")


_GRAMS = """list_concat(list_concat(['<s>'], regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')), ['</s>'])"""


def _kneser_ney(m: str) -> str:
    """SQL: for the model of label m, p{m} of every bigram asked."""
    d = N.DISCOUNT
    return f"""c{m} AS (SELECT ctx, w, count(*) AS c FROM g WHERE label = {m} GROUP BY ALL),
x{m} AS (SELECT ctx, sum(c) AS total, count(*) AS kinds FROM c{m} GROUP BY ctx),
u{m} AS (SELECT w, count(*) AS c FROM c{m} GROUP BY w),
t{m} AS (SELECT sum(c) AS total, count(*) AS kinds FROM u{m}),
l{m} AS (SELECT a.*, (greatest(coalesce(u.c, 0) - {d}, 0) + {d} * t.kinds / (v.size + 1)) / t.total AS p FROM a CROSS JOIN v CROSS JOIN t{m} t LEFT JOIN u{m} u USING (w)),
p{m} AS (SELECT l.ctx, l.w, CASE WHEN x.total IS NULL THEN l.p ELSE (greatest(coalesce(c.c, 0) - {d}, 0) + {d} * x.kinds * l.p) / x.total END AS p
  FROM l{m} l LEFT JOIN c{m} c ON c.ctx = l.ctx AND c.w = l.w LEFT JOIN x{m} x ON x.ctx = l.ctx)"""


@query(f"""WITH d AS (SELECT toxic AS label, {_GRAMS} AS ws FROM documents JOIN labels USING (doc_id) WHERE toxic IN (0, 1)),
g AS (SELECT label, unnest(ws[1:len(ws) - 1]) AS ctx, unnest(ws[2:]) AS w FROM d),
r AS (SELECT item_id, {_GRAMS} AS ws FROM benchmark), q AS (SELECT item_id, unnest(ws[1:len(ws) - 1]) AS ctx, unnest(ws[2:]) AS w FROM r),
a AS (SELECT DISTINCT ctx, w FROM q), v AS (SELECT count(DISTINCT w) AS size FROM g),
{_kneser_ney("1")}, {_kneser_ney("0")}
SELECT item_id, count(*) - 1 AS words, round(avg(ln(p1.p / p0.p)), 6) AS score FROM q JOIN p1 ON p1.ctx = q.ctx AND p1.w = q.w JOIN p0 ON p0.ctx = q.ctx AND p0.w = q.w GROUP BY item_id""")
def text_judge(spark, sf_dir):
    """Records judged by two Kneser-Ney models, of records labelled anomalous and of normal ones."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rounded(N.log_odds(table(spark, sf_dir, "benchmark"), docs.where("toxic = 1"), docs.where("toxic = 0"), ["item_id"], "text"), "score")
