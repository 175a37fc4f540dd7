"""Near-dedup of embeddings: spherical k-means cells, and blocked cosine products within them.

Vectors are compared only within a label (and dimension). Equal vectors are one row with a count. Centroids are fitted per
label on a bounded sample; every vector is assigned. Cells that stay large get centroids of their own. A pair whose cosine reaches the threshold can be cut by the border of
two cells only if one of the two lies within half their chord of it, so vectors that near also visit the cell beyond, and
no pair is lost. A pair that meets in several cells counts in the first. Vectors without clusters lie near most borders, and
cells that each visits would cost more than one; what is not cut well stays whole. Cells are cut into blocks of bounded size, a
task takes the product of two blocks in parts and sums up links, so neither a hot cell nor a group of copies is gathered or
listed as pairs. Blocks are as large as a task can hold, since a vector goes to as many tasks as its cell has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components

COSINE = 0.93
#: Rows that k-means is fitted on, vectors it aims at in a cell, cells in all, rounds.
SAMPLE, CELL, CELLS, ROUNDS = 16_384, 1024, 4096, 8
#: Times a cell's aim beyond which it is cut again, cells it is cut into at most, rows that those are fitted on.
LARGE, SUBCELLS, SUBSAMPLE = 8, 256, 8192
#: Times that cells must cut the products of what they divide; else it stays whole. 0 cuts always.
GAIN = 2
#: Vectors in a block and their components at most; blocks that a cell is cut into even if fewer held it, so that tasks share it; vectors in a part of a product.
BLOCK, COMPONENTS, BLOCKS, PART = 1 << 16, 1 << 21, 3, 2048
#: Copies of a vector that one task takes; heavy vectors up to which their list is sent to all tasks.
COPIES, LISTED = 1 << 16, 1 << 20

#: A cell's number is that of its first cut, shifted by so many bits, and that of its second one.
_SHIFT = 20


def _usable(v: str) -> str:
    return f"{v} is not null and forall({v}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({v}, x -> x <> 0)"


def _unit(vecs) -> np.ndarray:
    """Rows of length 1. The largest component is divided out first, so that no square overflows or vanishes."""
    rows = np.concatenate([np.asarray(v) for v in vecs]).astype(np.float64).reshape(len(vecs), -1)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return rows


def spherical_k_means(rows: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Unit centroids, k at most, of unit rows."""
    centers = rows[np.random.default_rng(seed).choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        sums = np.zeros_like(centers)
        np.add.at(sums, (rows @ centers.T).argmax(1), rows)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centers)
    return np.unique(centers, axis=0)


def fit_cells(sample: pd.DataFrame, sizes: dict[tuple[int, int], int], cosine: float = COSINE, block: int = BLOCK, cell: int = CELL, cells: int = CELLS, gain: float = GAIN) -> dict[tuple[int, int], np.ndarray]:
    """Centroids by (label, dim), for groups of over one cell that they cut well; a group has its share of the cells at most."""
    total, out = sum(sizes.values()), {}
    for key, own in sample.groupby(["label", "dim"]):
        if (k := min(-(-sizes[key] // cell), max(1, cells * sizes[key] // total), len(own))) > 1:
            centers = spherical_k_means(unit := _unit(own["vec"]), k)
            if cut_well(unit, centers, sizes[key], cosine, block, gain):
                out[key] = centers
    return out


def visits(unit: np.ndarray, centers: np.ndarray, cosine: float) -> np.ndarray:
    """Which cells each unit vector is in: its nearest, and those whose border is within half the chord of the cosine."""
    near = unit @ centers.T
    home = near.argmax(1)
    gap = np.sqrt(np.maximum(2 - 2 * centers @ centers.T, 1e-300))
    return near.max(1, keepdims=True) - near <= gap[home] * (np.sqrt(2 - 2 * cosine) / 2 + 1e-9)


def _most(block: int, dim: int) -> int:
    """Vectors in a block at most."""
    return max(1, min(block, COMPONENTS // dim))


def cut_well(sample: np.ndarray, centers: np.ndarray, n: int, cosine: float, block: int, gain: float) -> bool:
    """Whether n vectors that visit cells as their sample does take fewer products there by the gain, and go to no more tasks."""

    def sent(rows: np.ndarray) -> float:
        return float((rows * np.maximum(np.ceil(rows / _most(block, sample.shape[1])), np.minimum(np.ceil(rows / PART), BLOCKS))).sum())

    inside = visits(sample, centers, cosine).mean(0) * n
    return gain == 0 or bool(gain * (inside**2).sum() <= float(n) ** 2 and sent(inside) <= sent(np.array([n])))


def _groups(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable, by index, over links a[i] - b[i]."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            return root


def _links(tile: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Of one tile: for each vector with links its number of linked rows, and the least vector it is joined with.

    Products are in single precision first, a part at a time. Where one comes within its rounding of the threshold, those
    rows and columns of the part are taken in double precision, which alone decides.
    """
    cell, i, j = tile["cell"].iloc[0], tile["i"].iloc[0], tile["j"].iloc[0]
    tile = tile.sort_values("rep", ignore_index=True)  # so that the least index is the least rep
    nothing = pd.DataFrame({"rep": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
    left = np.flatnonzero(tile["block"] == i)
    right = left if i == j else np.flatnonzero(tile["block"] == j)
    if not len(left) or not len(right):
        return nothing
    reps, rows = tile["rep"].to_numpy(np.int64), tile["n"].to_numpy(np.int64)
    unit = _unit(tile["vec"])
    rough = unit.astype(np.float32)
    near = cosine - (unit.shape[1] + 8) * 1.2e-7  # more than what single precision may take away
    # cells below this one, in which pairs have met already
    earlier = [[c for c in v if c < cell] for v in tile["cells"]]
    links, ends = np.zeros(len(tile), np.int64), []
    for x in range(0, len(left), PART):
        for y in range(x if i == j else 0, len(right), PART):
            a, b = left[x : x + PART], right[y : y + PART]
            maybe = rough[a] @ rough[b].T >= near
            if not maybe.any():
                continue
            a, b = a[maybe.any(1)], b[maybe.any(0)]
            linked = unit[a] @ unit[b].T >= cosine
            if i == j and x == y:
                linked &= a[:, None] < b
            if met := {c for at in a for c in earlier[at]} & {c for at in b for c in earlier[at]}:
                place = {c: k for k, c in enumerate(met)}
                linked &= _inside(earlier, a, place) @ _inside(earlier, b, place).T == 0
            links[a] += linked @ rows[b]
            links[b] += linked.T @ rows[a]
            ends.append(_stars(linked, a, b))
    if not ends:
        return nothing
    root = reps[_groups(len(reps), *map(np.concatenate, zip(*ends, strict=True)))]
    return pd.DataFrame({"rep": reps, "links": links, "root": root})[links > 0]


def _stars(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what a matrix of links joins, each index at most once with the least that it reaches."""
    own = np.union1d(a, b)
    at, to, root = np.searchsorted(own, a), np.searchsorted(own, b), np.arange(len(own))
    while True:
        before = root.copy()
        root[at] = np.minimum(root[at], np.where(linked, root[to], len(own)).min(1))
        root[to] = np.minimum(root[to], np.where(linked, root[at][:, None], len(own)).min(0))
        root = root[root]
        if (root == before).all():
            joined = root != np.arange(len(own))
            return own[joined], own[root[joined]]


def _inside(earlier: list[list[int]], at: np.ndarray, place: dict[int, int]) -> np.ndarray:
    """Which of some cells, by column, each vector has been in."""
    out = np.zeros((len(at), len(place)), np.float32)
    for k, own in enumerate(at):
        out[k, [place[c] for c in earlier[own] if c in place]] = 1
    return out


def _cut_large(placed: DataFrame, scratch: Scratch, cosine: float, cell: int, block: int, gain: float) -> DataFrame:
    """placed, with cells of over LARGE times their aim cut by centroids fitted in tasks on a bounded sample of each, if that cuts them well.

    A pair that met in the cell meets in a part of it, by the same rule of visits. Rows of a large cell are dealt to tasks
    by salt, each with a copy of its centroids.
    """
    where = ["label", "dim", "cell"]
    label = placed.schema["label"].dataType.simpleString()
    inside = placed.select("rep", "label", "dim", "vec", F.explode("cells").alias("cell"))
    large = scratch.write(inside.groupBy(*where).count().where(F.col("count") > LARGE * cell).withColumn("salts", F.ceil(F.col("count") / 16_384)), "large")
    if large.isEmpty():
        return placed
    rows = inside.join(large, where)
    # a sample by threshold of the hash, so that no cell is ranked as a whole
    drawn = F.pmod(F.xxhash64("vec", "rep"), F.lit(1 << 30)) < F.lit(SUBSAMPLE) / F.col("count") * (1 << 30)

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("rep")
        n = int(own["count"].iloc[0])
        centers = spherical_k_means(unit := _unit(own["vec"]), min(SUBCELLS, -(-n // cell)))
        return pd.DataFrame({c: [own[c].iloc[0]] for c in [*where, "salts"]} | {"centers": [centers.ravel()]})[: int(cut_well(unit, centers, n, cosine, block, gain))]

    fitted = scratch.write(rows.where(drawn).groupBy(*where).applyInPandas(fit, f"label {label}, dim int, cell long, salts long, centers array<double>"), "centers")
    if fitted.isEmpty():
        return placed
    large = fitted.select(*where, "salts")
    rows = inside.join(large, where)
    copies = fitted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select(*(F.col(c).alias(f"_{c}") for c in [*where, "salt"]), "centers")

    def assign(own: pd.DataFrame, centers: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"rep": [], "part": []}).astype("int64")
        at = np.asarray(centers["centers"].iloc[0], np.float64).reshape(-1, int(own["dim"].iloc[0]))
        i, part = np.nonzero(visits(_unit(own["vec"]), at, cosine))
        return pd.DataFrame({"rep": own["rep"].to_numpy()[i], "part": own["cell"].to_numpy()[i] + part + 1})

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")))
    parts = salted.groupBy(*where, "salt").cogroup(copies.groupBy("_label", "_dim", "_cell", "_salt")).applyInPandas(assign, "rep long, part long")
    kept = inside.join(large.select(*where), where, "left_anti").select("rep", F.col("cell").alias("part"))
    # a vector's cells: a bounded list for each, as it visits few
    lists = parts.unionByName(kept).groupBy("rep").agg(F.array_sort(F.collect_set("part")).alias("cells"))
    return scratch.write(placed.drop("cells").join(lists, "rep"), "parts")


def _spread(rows: DataFrame, named: DataFrame, scratch: Scratch, copies: int) -> DataFrame:
    """rows joined with named by label and key. A vector of over `copies` rows is dealt to tasks by salt.

    Which those are is a list of hashes, a row for each `copies` rows of the table at most, sent to all tasks while it is
    short; beyond, the join is plain, and left to the session's splitting of skewed partitions.
    """
    hashed = F.xxhash64("label", "key")
    heavy = scratch.write(named.where(F.col("n") > copies).groupBy(hashed.alias("_hash")).agg(F.ceil(F.max("n") / copies).alias("_salts")), "heavy")
    if heavy.limit(LISTED + 1).count() > LISTED:
        return rows.join(named, ["label", "key"])
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.withColumn("_hash", hashed).join(F.broadcast(heavy), "_hash", "left").withColumn("_salt", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), salts))
    right = named.withColumn("_hash", hashed).join(F.broadcast(heavy), "_hash", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_salts", "_hash")
    return left.drop("_salts", "_hash").join(right, ["label", "key", "_salt"])


def near_duplicates(
    vectors: DataFrame,
    cosine: float = COSINE,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    sample: int = SAMPLE,
    cell: int = CELL,
    cells: int = CELLS,
    block: int = BLOCK,
    copies: int = COPIES,
    gain: float = GAIN,
) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    n_links counts other rows linked directly: equal label, equal dimension, cosine in double precision at the threshold
    or over. component_id is the smallest vec_id reachable; kept tells whether it is the row's own. Vectors that are null,
    empty, zero or hold null or non-finite components, and those with null labels, link with nothing. Equal rows count as
    other rows, and rows that share the component's id are all kept. Null ids link, but name no component that has an id.
    Rows find their vector's result by the SHA-256 of its components, so vectors aren't shuffled again for that.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "embed")
    # single precision stays, at half the bytes
    kind = "float" if isinstance(vectors.schema[embedding].dataType, T.ArrayType) and isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType) else "double"
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("vec"), F.col(label).alias("label"))
    rows = rows.withColumn("vec", F.expr(f"transform(vec, x -> if(x = 0, cast(0 as {kind}), x))"))  # no negative zeros
    digest = F.unhex(F.sha2(F.array_join("vec", ",").cast("binary"), 256))
    usable = F.col("label").isNotNull() & F.coalesce(F.expr(_usable("vec")), F.lit(False))
    distinct = rows.where(usable).groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    reps = scratch.write(distinct.select(F.monotonically_increasing_id().alias("rep"), "label", F.size("vec").alias("dim"), "vec", digest.alias("key"), "least", "n"), "distinct")
    sizes = scratch.write(reps.groupBy("label", "dim").count(), "sizes")
    # only groups of over one cell need centroids; there are fewer than rows / cell of them, and at most `cells` are fitted
    big = {(r["label"], r["dim"]): r["count"] for r in sizes.where(F.col("count") > cell).orderBy(F.desc("count")).limit(cells // 2).collect()}
    centers: dict[tuple[int, int], np.ndarray] = {}
    if big:
        part = min(1.0, 1.25 * sample / sum(big.values()))
        picked = reps.where((F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int(part * (1 << 30)))).limit(sample).select("label", "dim", "vec").toPandas()
        centers = fit_cells(picked[[k in big for k in zip(picked["label"], picked["dim"], strict=True)]], big, cosine, block, cell, cells, gain)
    shared = spark.sparkContext.broadcast(centers)  # `cells` vectors at most

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for key, own in rows.groupby(["label", "dim"]):
                at = shared.value.get(key)
                if at is None:
                    yield own.assign(cells=[[0]] * len(own))
                    continue
                yield own.assign(cells=[(np.nonzero(v)[0] << _SHIFT).tolist() for v in visits(_unit(own["vec"]), at, cosine)])

    placed = reps.select("rep", "label", "dim", "vec", "n", F.array(F.lit(0).cast("long")).alias("cells"))
    if centers:
        placed = scratch.write(placed.drop("cells").mapInPandas(assign, placed.schema), "assigned")
    placed = _cut_large(placed, scratch, cosine, cell, block, gain)
    inside = placed.withColumn("cell", F.explode("cells"))
    held, shared_by = F.least(F.lit(block), F.floor(F.lit(COMPONENTS) / F.col("dim"))), F.least(F.lit(BLOCKS), F.ceil(F.col("count") / PART))
    counted = inside.groupBy("label", "dim", "cell").count().where("count > 1")
    blocks = scratch.write(counted.withColumn("blocks", F.greatest(F.ceil(F.col("count") / F.greatest(held, F.lit(1))), shared_by).cast("int")).drop("count"), "blocks")
    dealt = inside.join(blocks, ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = dealt.select("label", "dim", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n", "vec", "cells")
    found = scratch.write(tiles.groupBy("label", "dim", "cell", "i", "j").applyInPandas(lambda tile: _links(tile, cosine), "rep long, links long, root long"), "links")
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch).withColumnRenamed("id", "rep")
    named = reps.drop("vec").join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = named.join(ids, "component").join(links, "rep", "left").select("label", "key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    named = scratch.write(named, "named")
    out = rows.withColumn("_usable", usable)
    own = _spread(out.where("_usable").select("vec_id", "label", digest.alias("key")), named, scratch, copies).select("vec_id", "n_links", "component_id")
    alone = out.where(~F.col("_usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
