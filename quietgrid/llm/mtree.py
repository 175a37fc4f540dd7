"""Exact top-k inner products by best-first search in M-trees.

Integer vectors get one more coordinate, sqrt(M^2 - |x|^2), so that all have length M and the largest inner product with a
query is the smallest Euclidean distance, which is a metric. Vectors are dealt to shards around pivots; each shard is an
M-tree whose nodes are pages in a table: entries with their routing vector, covering radius and distance to the parent's
routing vector. A search keeps pages in a heap by their lower bound, and leaves out distance computations that the stored
distances exclude by the triangle inequality. It begins in the query's nearest shard; other shards are visited only if
their covering radius lets them beat what was found there.

Bounds are in floating point, in units of the largest component of the table, and only exclude, with room for rounding.
Scores are sums of integer products: in floating point or 64-bit integers where no sum of the table can leave their exact
range, in Python's integers otherwise.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

K, SCALE = 10, 1024
#: Entries in a leaf and in an inner page, vectors in a shard (about), pivots at most, queries in a block.
LEAF, FAN, SHARD, PIVOTS, BLOCK = 256, 32, 8192, 1024, 2048
#: Scores beyond a long are given, and ranked, as the nearest long.
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1

_PAGE = "dim int, shard long, page int, leaf boolean, ids array<long>, times array<long>, vecs binary, norms binary, radius binary, parent binary"
_HIT = "query long, vec_id long, score long, times long"


@dataclass(frozen=True)
class Space:
    """What all vectors of a dimension share. Vectors are given as floor(scale * x) / scale, which a double holds exactly.

    unit: a power of two about as large as the largest component, and no less than half of it; top: M^2 in such units.
    """

    dim: int
    unit: float
    top: float
    scale: int

    def points(self, vecs: np.ndarray, query: bool = False) -> np.ndarray:
        """In units, with the added coordinate; that of queries is 0."""
        own = vecs / self.unit
        extra = np.zeros(len(own)) if query else np.sqrt(np.maximum(self.top - (own**2).sum(1), 0))
        return np.column_stack([own, extra])

    def scaled(self, score: float) -> float:
        """A score in squared units."""
        return float(score) / self.scale / self.unit / self.scale / self.unit

    @cached_property
    def most(self) -> Fraction:
        """What no sum of products exceeds."""
        return 4 * self.dim * Fraction(self.unit) ** 2 * self.scale**2

    def scores(self, vecs: np.ndarray, query: np.ndarray) -> list[int]:
        """The integer inner products of vectors with a query."""
        if self.most < 1 << 53:
            return ((vecs * self.scale) @ (query * self.scale)).astype(np.int64).tolist()
        if self.most < 1 << 63:
            return ((vecs * self.scale).astype(np.int64) @ (query * self.scale).astype(np.int64)).tolist()
        whole = lambda row: [int(Fraction(x) * self.scale) for x in row.tolist()]
        asked = whole(query)
        return [min(max(sum(a * b for a, b in zip(whole(v), asked, strict=True)), _LEAST), _MOST) for v in vecs]


def _split(vecs: np.ndarray, size: int, seed: int) -> list[np.ndarray]:
    """Index arrays of at most `size`, by nearest of some members; each begins with its routing member."""
    n = len(vecs)
    if n <= size:
        return [np.arange(n)]
    seeds = np.random.default_rng(seed).choice(n, -(-n * 4 // (size * 3)), replace=False)
    square = (vecs**2).sum(1)
    near = (square[seeds][None, :] - 2 * vecs @ vecs[seeds].T).argmin(1)
    near[seeds] = np.arange(len(seeds))
    out = []
    for s, first in enumerate(seeds):
        own = np.concatenate([[first], np.setdiff1d(np.flatnonzero(near == s), [first])])
        out += [own[i : i + size] for i in range(0, len(own), size)]
    return out


def build(vecs: np.ndarray, ids: np.ndarray, times: np.ndarray, space: Space, leaf: int = LEAF, fan: int = FAN) -> list[dict]:
    """Pages of an M-tree over vectors, the last being the root. A leaf has the vectors, other pages have routing points."""
    points = space.points(vecs)
    pages: list[dict] = []
    groups = _split(points, leaf, len(ids))
    # of each node of the level: its routing point, the points below it, its page
    level = []
    for own in groups:
        away = np.linalg.norm(points[own] - points[own[0]], axis=1)
        level.append((points[own[0]], own, len(pages)))
        pages.append({"leaf": True, "ids": ids[own], "times": times[own], "vecs": points[own], "radius": np.zeros(len(own)), "parent": away})
    while True:
        heads = np.array([x[0] for x in level])
        above = []
        for own in [np.arange(len(level))] if len(level) <= fan else _split(heads, fan, len(level)):
            below = np.concatenate([level[i][1] for i in own])
            radius = [np.linalg.norm(points[level[i][1]] - level[i][0], axis=1).max() for i in own]
            away = np.linalg.norm(heads[own] - heads[own[0]], axis=1)
            above.append((heads[own[0]], below, len(pages)))
            pages.append({"leaf": False, "ids": np.array([level[i][2] for i in own]), "times": np.ones(len(own), np.int64), "vecs": heads[own], "radius": np.array(radius), "parent": away})
        level = above
        if len(level) == 1:
            return pages


class Tree:
    """Pages as search() reads them."""

    def __init__(self, pages: list[dict], space: Space):
        self.pages, self.root, self.space = pages, len(pages) - 1, space
        self.computed = self.seen = 0

    def search(self, query: np.ndarray, own: int | None, k: int, found: list[tuple[int, int, int]], least: float = -np.inf) -> list[tuple[int, int, int]]:
        """found, a heap of (score, -id, times), k at most, with the k best of this tree merged in, but those with the id `own`.

        least: a score that k others reach.
        """
        space, point = self.space, self.space.points(query[None], query=True)[0]
        total = float((point**2).sum()) + space.top
        slack = 1e-9 * total

        def worst() -> float:
            """What a score must reach to count, in squared units, less what rounding may take away."""
            return space.scaled(max(least, found[0][0] if len(found) == k else -np.inf)) - slack

        def reach() -> float:
            """A distance beyond which no score counts; differences of large squares leave distances few digits."""
            low = worst()
            return np.inf if low == -np.inf else np.sqrt(max(0.0, total - 2 * low)) + np.sqrt(slack)

        heap, turn = [(0.0, 0, self.root, None)], 0
        while heap:
            bound, _, at, to_head = heapq.heappop(heap)
            limit = reach()
            if bound > limit:
                break
            page = self.pages[at]
            # what the distance to the page's routing point and the stored ones exclude isn't computed
            maybe = np.arange(len(page["ids"])) if to_head is None else np.flatnonzero(np.abs(to_head - page["parent"]) - page["radius"] <= limit)
            self.seen += len(page["ids"])
            self.computed += len(maybe)
            if not len(maybe):
                continue
            dots = page["vecs"][maybe] @ point
            if page["leaf"]:
                maybe = maybe[dots >= worst()]
                for i, score in zip(maybe.tolist(), space.scores(page["vecs"][maybe, :-1] * space.unit, query), strict=True):
                    key = (score, -int(page["ids"][i]), int(page["times"][i]))
                    if -key[1] == own:
                        continue
                    if len(found) < k:
                        heapq.heappush(found, key)
                    elif key > found[0]:
                        heapq.heapreplace(found, key)
            else:
                away = np.sqrt(np.maximum(total - 2 * dots, 0))
                low = np.maximum(away - page["radius"][maybe], 0)
                for i in np.flatnonzero(low <= limit):
                    turn += 1
                    heapq.heappush(heap, (float(low[i]), turn, int(page["ids"][maybe[i]]), float(away[i])))
        return found


def _floored(vector: str, scale: int) -> str:
    """SQL: floor(scale * x) / scale of each component, or null for a vector that takes no part. scale is a power of two.

    From 2^52 on, doubles are whole numbers, and dividing by a power of two loses nothing.
    """
    each = f"transform({vector}, x -> if(abs(cast(x as double) * {scale}) < 4503599627370496D, cast(floor(cast(x as double) * {scale}) as double) / {scale}, cast(x as double)))"
    fine = f"{vector} is not null and forall({vector}, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))"
    return f"if({fine}, {each}, null)"


def _spaces(kept: DataFrame, scale: int) -> dict[int, tuple[int, Space]]:
    """By dimension: the number of vectors, and their Space."""
    largest = "array_max(transform(vec, x -> abs(x)))"
    rows = kept.select("dim", F.expr(f"coalesce({largest}, 0D)").alias("most"), "vec").select("dim", "most", F.expr("2 * ln(most) + ln(aggregate(vec, 0D, (a, x) -> a + (x / most) * (x / most)))").alias("square"))
    out = {}
    for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("most").alias("most"), F.max("square").alias("square")).collect():
        unit = 2.0 ** min(1023, math.frexp(r["most"])[1]) if r["most"] else 1.0
        out[r["dim"]] = r["n"], Space(r["dim"], unit, math.exp(r["square"] - 2 * math.log(unit)) * (1 + 1e-9) if r["most"] else 0.0, scale)
    return out


def _pivots(kept: DataFrame, spaces: dict[int, tuple[int, Space]], shard: int, most: int) -> dict[int, np.ndarray]:
    """By dimension: vectors around which shards lie, first by hash; `most` for all dimensions together, one at least for each.

    Rows under a threshold of the hash are taken, a quarter more than wanted, so nothing is ranked as a whole.
    """
    whole = sum(n for n, _ in spaces.values())
    wanted = {d: min(-(-n // shard) * 2, max(1, most * n // whole)) for d, (n, _) in spaces.items()}
    drawn = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(1 << 30))
    limits = kept.sparkSession.createDataFrame([(d, min(1 << 30, int((1.25 * wanted[d] + 32) / spaces[d][0] * (1 << 30)) + 1)) for d in wanted], "dim int, _limit long")
    rows = kept.select("dim", "vec", drawn.alias("_draw")).join(F.broadcast(limits), "dim")  # a row for each dimension
    few = rows.where("_draw < _limit").select("dim", "_draw", "vec").unionByName(rows.groupBy("dim").agg(F.min("_draw").alias("_draw"), F.min_by("vec", "_draw").alias("vec")))
    out: dict[int, list] = {}
    for r in sorted(few.distinct().collect(), key=lambda r: (r["_draw"], r["vec"])):
        if len(out.setdefault(r["dim"], [])) < wanted[r["dim"]]:
            out[r["dim"]].append(r["vec"])
    return {d: spaces[d][1].points(np.array(v, np.float64).reshape(len(v), d)) for d, v in out.items()}


def top_k(vectors: DataFrame, every: int = 100, k: int = K, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", shard: int = SHARD, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: of each query its k highest inner products, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`; candidates are rows with other ids and equally many
    components. Components become floor(scale * x), scale being a power of two. Vectors that are null or hold null or
    non-finite components take no part, nor do null ids. A score that no long can hold is the nearest long, and ranks as
    such. A repeated candidate takes a rank for each of its rows; queries of equal id and vector are one, queries of equal
    id and different vectors have k results each. Of equal vectors the k + 1 smallest ids are kept: no more can be among k
    results. Fewer candidates give fewer results; no rows give no rows.
    """
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale is no power of two")
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "mtree")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.expr(_floored(f"`{embedding}`", scale)).alias("vec")).where("vec_id is not null and vec is not null")
    rows = rows.groupBy("vec_id", "vec").agg(F.size("vec").alias("dim"), F.count("*").alias("times"))
    first = Window.partitionBy("vec").orderBy("vec_id")
    kept = scratch.write(rows.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= k + 1).drop("_nth"), "vectors")
    queries = scratch.write(rows.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), "vec", "dim"), "queries")
    found = _spaces(kept, scale)
    spaces = {d: space for d, (_, space) in found.items()}
    # a bounded fit, from which only shards depend
    shared = spark.sparkContext.broadcast(_pivots(kept, found, shard, pivots) if found else {})

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for dim, own in rows.groupby("dim"):
                away = _away(spaces[dim].points(_matrix(own["vec"], dim)), shared.value[dim])
                yield own.assign(pivot=away.argmin(1), away=away.min(1))

    placed = scratch.write(kept.mapInPandas(nearest, "vec_id long, vec array<double>, dim int, times long, pivot long, away double"), "placed")
    around = scratch.write(placed.groupBy("dim", "pivot").agg(F.max("away").alias("radius"), F.ceil(F.count("*") / shard).alias("parts")), "pivots")
    radius = {d: np.zeros(len(v)) for d, v in shared.value.items()}
    parts = {d: np.zeros(len(v), np.int64) for d, v in shared.value.items()}
    for r in around.collect():  # one row for each pivot
        radius[r["dim"]][r["pivot"]], parts[r["dim"]][r["pivot"]] = r["radius"], r["parts"]
    dealt = placed.join(around.select("dim", "pivot", "parts"), ["dim", "pivot"]).withColumn("shard", F.col("pivot") * F.lit(1 << 32) + F.pmod(F.xxhash64("vec_id"), F.col("parts")))

    def plant(own: pd.DataFrame) -> pd.DataFrame:
        dim, number = int(own["dim"].iloc[0]), own["shard"].iloc[0]
        own = own.sort_values("vec_id", kind="stable")
        pages = build(_matrix(own["vec"], dim), own["vec_id"].to_numpy(np.int64), own["times"].to_numpy(np.int64), spaces[dim])
        raw = lambda a: np.ascontiguousarray(a, np.float64).tobytes()
        rows = [(dim, number, i, p["leaf"], p["ids"].astype(np.int64), p["times"], raw(p["vecs"][:, :-1]), raw(p["vecs"][:, -1]), raw(p["radius"]), raw(p["parent"])) for i, p in enumerate(pages)]
        return pd.DataFrame(rows, columns=["dim", "shard", "page", "leaf", "ids", "times", "vecs", "norms", "radius", "parent"])

    pages = scratch.write(dealt.groupBy("dim", "shard").applyInPandas(plant, _PAGE), "pages")
    blocks = max(1, -(-queries.count() // block))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))

    def bounds(home: bool):
        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for dim, own in rows.groupby("dim"):
                    space, at = spaces[dim], shared.value[dim]
                    points = space.points(_matrix(own["vec"], dim), query=True)
                    away, total = _away(points, at), (points**2).sum(1) + space.top
                    near, asks = away.argmin(1), np.zeros(away.shape, bool)
                    if home:
                        asks[np.arange(len(own)), near] = True
                    else:
                        low = np.maximum(away - radius[dim], 0)
                        least = np.array([space.scaled(x) for x in own["least"]])[:, None]
                        # a shard is left out only if nothing in it can reach the score that k others have
                        asks = np.isnan(least) | ((total * (1 + 1e-6))[:, None] - low * low >= 2 * least)
                        asks[np.arange(len(own)), near] = False
                    q, p = np.nonzero(asks)
                    n = parts[dim][p]
                    q, first = np.repeat(q, n), np.repeat(p.astype(np.int64) << 32, n)
                    sub = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
                    asked = own.iloc[q]
                    yield pd.DataFrame({"dim": dim, "shard": first + sub, "block": asked["block"].to_numpy(), "query": asked["query"].to_numpy(), "query_id": asked["query_id"].to_numpy(), "vec": asked["vec"].array, "least": asked["least"].to_numpy()})

        return task

    def visit(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        if len(asked) and len(own):
            dim = int(own["dim"].iloc[0])
            tree = Tree(_loaded(own, dim), spaces[dim])
            for query, query_id, vec, least in zip(asked["query"], asked["query_id"], asked["vec"], asked["least"], strict=True):
                hits = tree.search(np.asarray(vec, np.float64), int(query_id), k, [], -np.inf if pd.isna(least) else least)
                out += [(query, -i, s, n) for s, i, n in hits]
        return pd.DataFrame(out, columns=["query", "vec_id", "score", "times"]).astype("int64")

    asked_type = "dim int, shard long, block long, query long, query_id long, vec array<double>, least double"

    def search(asked: DataFrame) -> DataFrame:
        on = ["dim", "shard", "block"]
        # pages go to each block of queries that asks for them
        needed = asked.select(*(F.col(c).alias(f"_{c}") for c in on)).distinct()
        needed = pages.join(needed, (F.col("dim") == F.col("_dim")) & (F.col("shard") == F.col("_shard")))
        return asked.groupBy(*on).cogroup(needed.groupBy("_dim", "_shard", "_block")).applyInPandas(visit, _HIT)

    none = queries.withColumn("least", F.lit(None).cast("double"))
    near = scratch.write(search(scratch.write(none.mapInPandas(bounds(True), asked_type), "asked")), "near")
    # a double may be above the long it stands for, so a little less is asked for
    least = F.col("least").cast("double")
    known = queries.join(_kth(near, k), "query", "left").withColumn("least", least - F.abs(least) * 1e-15 - 1)
    far = search(scratch.write(known.mapInPandas(bounds(False), asked_type), "asked"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    copies = near.unionByName(far).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k)))))
    ranked = copies.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(queries.select("query", "query_id"), "query").select("query_id", "rank", "vec_id", "score")


def _kth(hits: DataFrame, k: int) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("_turn", turn).where(F.col("_turn") == k).select("query", F.col("score").alias("least"))


def _matrix(vecs, dim: int) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vecs], np.float64).reshape(len(vecs), dim)


def _away(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0))


def _loaded(rows: pd.DataFrame, dim: int) -> list[dict]:
    out = []
    for r in rows.sort_values("page").itertuples():
        n = len(r.ids)
        vecs = np.column_stack([np.frombuffer(r.vecs).reshape(n, dim), np.frombuffer(r.norms)])
        out.append({"leaf": r.leaf, "ids": np.asarray(r.ids), "times": np.asarray(r.times), "vecs": vecs, "radius": np.frombuffer(r.radius), "parent": np.frombuffer(r.parent)})
    return out


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, vec FROM v WHERE vec_id % 100 = 0),
pairs AS (
  SELECT q.vec_id AS query_id, q.vec AS query, c.vec_id,
         greatest(least(coalesce(list_sum(list_transform(range(1, len(q.vec) + 1), lambda i: q.vec[i] * c.vec[i])), 0), 9223372036854775807::HUGEINT), -9223372036854775808::HUGEINT)::BIGINT AS score
  FROM q JOIN v c ON c.vec_id <> q.vec_id AND len(c.vec) = len(q.vec)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
