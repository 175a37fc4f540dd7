"""Queries along time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import temporal as T
from ..operators.sampling import first_frames as first_of
from .bindings import FRAMES, frames, rounded
from .register import query

_KEYS = ["video"]
GAIN = T.steady_gain(0.05)


def _plain(df, *names):
    return rounded(df.select("event_id", *names), *names)


@query(f"""WITH {FRAMES}
SELECT event_id, round(list_sort([l[greatest(0, least(p, n - 1)) + 1] FOR p IN range(t - 4, t + 5)])[5], 6) AS s
FROM (SELECT *, list(x) OVER (PARTITION BY video ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, count(*) OVER (PARTITION BY video) AS n FROM frames)""")
def centred_median(spark, sf_dir):
    return _plain(T.centred_median(frames(spark, sf_dir), _KEYS, "t", "x", "s"), "s")


@query(f"""WITH {FRAMES}
SELECT event_id, round(list_sort([l[greatest(0, p) + 1] FOR p IN range(t - 8, t + 1)])[5], 6) AS s
FROM (SELECT *, list(x) OVER (PARTITION BY video ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM frames)""")
def causal_median_padded(spark, sf_dir):
    return _plain(T.causal_median_padded(frames(spark, sf_dir), _KEYS, "t", "x", "s"), "s")


@query(f"WITH {FRAMES} SELECT event_id, round(median(x) OVER (PARTITION BY video ORDER BY t ROWS BETWEEN 8 PRECEDING AND CURRENT ROW), 6) AS s FROM frames")
def causal_median(spark, sf_dir):
    return _plain(T.causal_median(frames(spark, sf_dir), _KEYS, "t", "x", "s"), "s")


_FORWARD = f"""fwd AS (
  SELECT *, list_reduce(list(x) OVER (PARTITION BY video ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, b: a + {GAIN!r} * (b - a)) AS s,
         list_reverse(list(x) OVER (PARTITION BY video ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS nxt
  FROM frames)"""


@query(f"WITH {FRAMES}, {_FORWARD} SELECT event_id, round(s, 6) AS s FROM fwd")
def causal_kalman(spark, sf_dir):
    return _plain(T.causal_kalman(frames(spark, sf_dir), _KEYS, "t", "x", "s", GAIN), "s")


@query(f"WITH {FRAMES}, {_FORWARD} SELECT event_id, round(CASE WHEN len(nxt) > 1 THEN 0.5 * s + 0.5 * list_reduce(nxt, lambda a, b: a + {GAIN!r} * (b - a)) ELSE s END, 6) AS s FROM fwd")
def fixed_lag_kalman(spark, sf_dir):
    return _plain(T.fixed_lag_kalman(frames(spark, sf_dir), _KEYS, "t", "x", "s", GAIN), "s")


def _smooth(index: str) -> str:
    return f"""WITH {FRAMES},
n AS (SELECT *, count(*) OVER (PARTITION BY video) AS n FROM frames),
taps AS (SELECT tap::BIGINT AS tap, exp(-0.5 * (tap / 3.0::DOUBLE) * (tap / 3.0::DOUBLE)) AS w FROM range(-12, 13) r(tap)),
want AS (SELECT a.event_id, a.video, w, {index} AS t FROM n a CROSS JOIN taps)
SELECT w.event_id, round(sum(w.w * f.x) / (SELECT sum(w) FROM taps), 6) AS s FROM want w JOIN frames f ON f.video = w.video AND f.t = w.t GROUP BY 1"""


@query(_smooth("greatest(0, least(a.t + tap, n - 1))"))
def gaussian_nearest(spark, sf_dir):
    return _plain(T.gaussian(frames(spark, sf_dir), _KEYS, "t", "x", "s"), "s")


@query(_smooth("CASE WHEN ((a.t + tap) % (2 * n) + 2 * n) % (2 * n) < n THEN ((a.t + tap) % (2 * n) + 2 * n) % (2 * n) ELSE 2 * n - 1 - ((a.t + tap) % (2 * n) + 2 * n) % (2 * n) END"))
def gaussian_reflect(spark, sf_dir):
    return _plain(T.gaussian(frames(spark, sf_dir), _KEYS, "t", "x", "s", mode="reflect"), "s")


@query(f"WITH {FRAMES} SELECT event_id, round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w + 1e-12), 6) AS s FROM frames WINDOW w AS (PARTITION BY video)")
def video_min_max(spark, sf_dir):
    return _plain(T.min_max(frames(spark, sf_dir), _KEYS, "x", "s"), "s")


@query(f"""WITH {FRAMES} SELECT a.event_id, round(b.x - c.x, 6) AS s FROM frames a
LEFT JOIN frames b ON b.video = a.video AND b.t = greatest(a.t, 2) LEFT JOIN frames c ON c.video = a.video AND c.t = greatest(a.t, 2) - 2""")
def lag_difference(spark, sf_dir):
    return _plain(T.lag_difference(frames(spark, sf_dir), _KEYS, "t", "x", "s"), "s")


@query(f"WITH {FRAMES} SELECT a.event_id, round(b.x, 6) AS s FROM frames a JOIN frames b ON b.video = a.video AND b.t = a.t - a.t % 4")
def causal_hold(spark, sf_dir):
    return _plain(T.causal_hold(frames(spark, sf_dir), _KEYS, "t", "x", "s"), "s")


@query(f"""WITH {FRAMES},
n AS (SELECT *, count(*) OVER (PARTITION BY video) AS n FROM frames),
want AS (SELECT event_id, video, i, greatest(0, least(greatest(t, 6), n - 1) - 6 + 2 * i) AS t FROM n CROSS JOIN range(0, 4) r(i))
SELECT w.event_id, round(max(x) FILTER (i = 0), 6) AS c0, round(max(x) FILTER (i = 1), 6) AS c1, round(max(x) FILTER (i = 2), 6) AS c2, round(max(x) FILTER (i = 3), 6) AS c3
FROM want w JOIN frames f ON f.video = w.video AND f.t = w.t GROUP BY 1""")
def clip_assembly(spark, sf_dir):
    df = T.clips(frames(spark, sf_dir), _KEYS, "t", "x", "clip")
    names = [f"c{i}" for i in range(4)]
    return _plain(df.select("event_id", *(F.col("clip")[i].alias(n) for i, n in enumerate(names))), *names)


@query(f"WITH {FRAMES} SELECT event_id, video, t FROM frames WHERE t < 5")
def first_frames(spark, sf_dir):
    """The first five frames of each camera: the bound is the feature."""
    return first_of(frames(spark, sf_dir), _KEYS, "t", 5).select("event_id", "video", "t")


@query(f"""WITH {FRAMES}, m AS (SELECT *, median(x) OVER (PARTITION BY video ORDER BY t ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS s FROM frames)
SELECT event_id, '[' || strftime(ts, '%H:%M:%S') || '] frame ' || t || ': ALARM score/thr=' || printf('%.2f', s / 3.5) AS line FROM m WHERE s > 3.5""")
def alarm_lines(spark, sf_dir):
    """What a live run prints, for smoothed values over a threshold of 3.5."""
    rows = T.causal_median(frames(spark, sf_dir), _KEYS, "t", "x", "s").where("s > 3.5")
    return rows.select("event_id", S.alarm_line(F.col("ts"), F.col("t"), F.col("s"), 3.5).alias("line"))
