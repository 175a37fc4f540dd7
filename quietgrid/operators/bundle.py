"""All detectors of a frame at once: residual detectors, the scene state's, the code mixture's, and their fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import background as B
from . import grid as G
from .latent import code_mixture, scene_states
from .lookup import lookup


def _vectors(maps: DataFrame, residual: str, dim: int, cell: int, width: int) -> DataFrame:
    """maps with cell_id and _f, the residual as an array."""
    own = F.array(F.col(residual).cast("double")) if dim == 1 else F.col(residual)
    return maps.withColumn("cell_id", G.cell_id(F.col("y"), F.col("x"), cell, width)).withColumn("_f", own)


def score_frames(maps: DataFrame, normal: DataFrame, frames: list[str], residual: str, height: int, width: int, cell: int, pool: int, nu: float | None = None, dim: int = 1) -> DataFrame:
    """frames, detector, score: the largest local mean of each residual detector's map.

    residual is a number, or an array of dim numbers. normal: maps of normal frames, from which the backgrounds come. All
    detectors are scored in one pass over long rows.
    """
    normal = _vectors(normal, residual, dim, cell, width)
    bg = B.finalise(B.moments(normal, ["cell_id"], "_f", dim), ["cell_id"], dim)
    rows = B.detectors(_vectors(maps, residual, dim, cell, width), bg, ["cell_id"], "_f", dim, nu)
    rows = B.weighted_rx(G.closing(rows, frames, "rem", "_closed"), frames, "_f" if dim > 1 else residual, "_closed", dim=dim)
    names = ["rem", "frx_global", "frx_cell", "frx_bayes", "wrx", *(["frx_t"] if nu is not None else [])]
    long = rows.select(*frames, "y", "x", F.explode(F.array(*(F.struct(F.lit(n).alias("detector"), F.col(n).alias("v")) for n in names))).alias("d")).select(*frames, "y", "x", "d.detector", "d.v")
    return G.frame_score(long, [*frames, "detector"], "v", height, width, pool)


def state_distances(maps: DataFrame, states: DataFrame, normal: DataFrame, frames: list[str], residual: str, cell: int, width: int, dim: int = 1, kappa0: float = B.KAPPA0) -> DataFrame:
    """frames, y, x, frx_state: distances from the background of the frame's most probable state.

    states: (frames, state) of all frames; normal: maps of normal frames. A pixel of a state and cell that no normal frame has
    is held against the cell's own background, as a state without frames is.
    """
    keyed = lambda m: _vectors(m, residual, dim, cell, width).join(states, frames)
    own = keyed(normal)
    parts = checkpointed(B.moments(own, ["state", "cell_id"], "_f", dim))
    seen = own.groupBy("state").agg(F.count_distinct(*frames).alias("frames"))
    base = B.finalise(B.merge(parts, ["cell_id"], dim), ["cell_id"], dim)
    model = B.state_background(parts, seen, base, "state", "cell_id", dim, kappa0)
    rows = lookup(lookup(keyed(maps), model, ["state", "cell_id"], how="left"), base.select("cell_id", "mu_b", "prec_b"), ["cell_id"])
    rows = rows.withColumn("mu", F.coalesce("mu", "mu_b")).withColumn("prec", F.coalesce("prec", "prec_b"))
    return rows.select(*frames, "y", "x", B.distance(F.col("_f"), F.col("mu"), F.col("prec"), dim).alias("frx_state"))


def patch_codes(maps: DataFrame, normal: DataFrame, frames: list[str], value: str, height: int, width: int, patch: int, stride: int, **options) -> DataFrame:
    """frames, y, x, bgmm: mean negative log density of the codes of the patches that cover a pixel, with their places in the frame."""
    starts = [max(1, G.patch_starts(size, patch, stride)[-1]) for size in (height, width)]
    place = lambda m: G.extract_patches(m, frames, value, height, width, patch, stride).withColumn("_py", F.col("py") / starts[0]).withColumn("_px", F.col("px") / starts[1])
    rows = code_mixture(place(maps), "values", [*frames, "py", "px"], "bgmm", ["_py", "_px"], normal=place(normal), **options)
    return G.patches_to_map(rows, frames, "bgmm", height, width, patch, stride)


def fuse_frames(scores: DataFrame, normal: DataFrame, frames: list[str], parts: tuple[str, ...] = ("frx_bayes", "bgmm"), out: str = "fused") -> DataFrame:
    """scores (frames, detector, score) and the sum of the parts' z-scores as another detector, on the scale of normal frames (a frame per row).

    Frames that lack a part have no sum.
    """
    scale = scores.where(F.col("detector").isin(*parts)).join(normal, frames, "left_semi").groupBy("detector").agg(F.avg("score").alias("_m"), (F.stddev_pop("score") + 1e-12).alias("_sd"))
    z = lookup(scores.where(F.col("detector").isin(*parts)), scale, ["detector"]).withColumn("_z", (F.col("score") - F.col("_m")) / F.col("_sd"))
    fused = z.groupBy(*frames).agg(F.sum("_z").alias("score"), F.count_distinct("detector").alias("_n")).where(F.col("_n") == len(parts))
    return scores.select(*frames, "detector", "score").unionByName(fused.select(*frames, F.lit(out).alias("detector"), "score"))


def all_scores(maps: DataFrame, normal: DataFrame, frames: list[str], value: str, height: int, width: int, cell: int, pool: int, view: int, patch: int, stride: int, nu: float | None = None, code: int = 16, states: int = 6, seed: int = 0) -> DataFrame:
    """frames, detector, score: residual detectors, frx_state, bgmm and fused, of maps of one value.

    normal: (frames) of normal frames, which alone the backgrounds, states, codes and scales learn from. view is the block of
    the coarse view by which states are recognised; patch and stride cut the codes' patches.
    """
    own = maps.join(normal, frames, "left_semi")
    scores = score_frames(maps, own, frames, value, height, width, cell, pool, nu)
    views = G.coarse_view(maps, frames, value, height, width, view).groupBy(*frames).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda s: s["mean"]).alias("_view"))
    found = checkpointed(scene_states(views, views.join(normal, frames, "left_semi"), "_view", frames, most=states, seed=seed).select(*frames, "state"))
    score = lambda m, name: G.frame_score(m, frames, name, height, width, pool).select(*frames, F.lit(name).alias("detector"), "score")
    state = score(state_distances(maps, found, own, frames, value, cell, width), "frx_state")
    code_scores = score(patch_codes(maps, own, frames, value, height, width, patch, stride, code=code, seed=seed), "bgmm")
    return fuse_frames(scores.select(*frames, "detector", "score").unionByName(state).unionByName(code_scores), normal, frames)
