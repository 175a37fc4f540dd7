"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions alone.

Sources share the mix by weight, capped at a multiple of their size (water-filling). Blocks of equal size are then given to
sources by highest quotients target / (2k + 1), and in the same way by each source to its shards, whose sizes are bounded.
A shard lays its documents out in seeded order, which cuts it into blocks; it takes whole rounds and then its first blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
#: Words in a block; words and documents in a shard, about; divisors tried at once, and how often at most: enough for adjacent doubles.
BLOCK, SHARD_WORDS, SHARD_DOCS, TRIED, ROUNDS = 4, 1 << 20, 1 << 16, 32, 20
SEED = "0"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _divisor(items: str, blocks: str) -> str:
    """SQL: the least divisor found by bisection that gives out `blocks` at most over items (array of struct t, m).

    floor(t / D + 1/2) is the number of quotients t / (2k + 1) that reach D / 2, so a divisor stands for a quotient.
    """
    given = f"aggregate({items}, 0D, (a, x) -> a + least(x.m, floor(x.t / d.mid + 0.5D)))"
    step = f"aggregate(array(named_struct('mid', (s.lo + s.hi) / 2)), s, (a, d) -> if({given} <= {blocks}, named_struct('lo', a.lo, 'hi', d.mid), named_struct('lo', d.mid, 'hi', a.hi)))"
    return f"aggregate(sequence(1, 120), named_struct('lo', 0D, 'hi', aggregate({items}, 1D, (a, x) -> greatest(a, x.t)) * 2 + 1), (s, i) -> {step}).hi"


def _seats(rows: DataFrame, group: list[str], order: list[str], blocks: str) -> DataFrame:
    """rows (t: claim, m: most blocks) and seats, given by highest quotients within each group, ties in the order named.

    Rounding at the group's divisor, column _d, gives all but the last few blocks; those go to the highest quotients that come
    next. Rows without that column are one group, whose claims fit one row, from which the divisor is found.
    """
    if "_d" not in rows.columns:
        found = rows.agg(F.collect_list(F.struct("t", "m")).alias("_items"), F.first(blocks).alias("_blocks")).select(F.expr(_divisor("_items", "_blocks")).alias("d")).first()
        rows = rows.withColumn("_d", F.lit(float(found["d"] or 1.0)))
    whole = Window.partitionBy(*group)
    rows = rows.withColumn("_sure", F.least(F.col("m"), F.floor(F.col("t") / F.col("_d") + 0.5))).withColumn("_left", F.col(blocks) - F.sum("_sure").over(whole))
    again = F.when(F.col("_sure") < F.col("m"), F.col("t") / (2 * F.col("_sure") + 1))
    turn = F.row_number().over(whole.orderBy(again.desc_nulls_last(), *(F.col(k).asc_nulls_last() for k in order)))
    seats = F.col("_sure") + ((turn <= F.col("_left")) & again.isNotNull()).cast("double")
    return rows.withColumn("seats", seats.cast("long")).drop("_d", "_sure", "_left")


def _divisors(shards: DataFrame, scratch: Scratch) -> DataFrame:
    """_s, _d: for each source a divisor that gives out its blocks or fewer over all its shards, each of which lacks one at most.

    Each round tries some divisors between two bounds by a sum over the shards for each source and divisor, so however many
    shards a source has, no row or task holds them together. First they are powers of two around claims over blocks; rounds
    end when the bounds are so near that no shard's claim gives it two blocks more at the one than at the other.
    """
    claims = shards.groupBy(F.col("source").alias("_s")).agg(F.sum("t").alias("_sum"), F.max("t").alias("_top"), F.sum(F.when(F.col("t") > 0, F.col("m")).otherwise(0.0)).alias("_all"), F.first("_blocks").alias("_most"))
    mean = F.when((F.col("_sum") > 0) & (F.col("_most") > 0), F.col("_sum") / F.col("_most")).otherwise(F.lit(1.0))
    powers = F.transform(F.sequence(F.lit(1), F.lit(TRIED)), lambda k: F.col("_mean") * F.pow(F.lit(2.0), k - TRIED // 2))
    most = F.greatest(F.col("_top") * 2 + 1, F.col("_mean") * 2.0 ** (TRIED // 2 + 1))
    # where all that shards can take is given out, any small divisor does
    now = claims.withColumn("_mean", mean).select("_s", "_top", "_most", (F.col("_all") <= F.col("_most")).alias("_done"), F.concat(F.array(F.lit(0.0)), powers, F.array(most)).alias("_at"), F.lit(1e-9).alias("_d"))
    now = scratch.write(now, "bounds")
    for _ in range(ROUNDS):
        if not now.where("not _done").limit(1).count():
            break
        k = F.explode(F.sequence(F.lit(1), F.lit(TRIED))).alias("_k")
        open_ = now.where("not _done").select("_s", "_at")
        each = shards.join(open_, shards["source"].eqNullSafe(open_["_s"])).select("_s", "t", "m", "_at", k)
        given = each.groupBy("_s", "_k").agg(F.sum(F.least(F.col("m"), F.floor(F.col("t") / F.element_at("_at", F.col("_k") + 1) + 0.5))).alias("_given"))
        given = given.groupBy(F.col("_s").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("_k", "_given"))).alias("_given"))  # TRIED of them
        # what is given falls as divisors grow: the first that gives no more than there is becomes the new upper bound
        first = F.coalesce(F.get(F.filter("_given", lambda g: g["_given"] <= F.col("_most")), F.lit(0))["_k"], F.lit(TRIED + 1))
        next_ = now.where("not _done").join(given, F.col("_s").eqNullSafe(F.col("_of"))).withColumn("_lo", F.element_at("_at", first)).withColumn("_hi", F.element_at("_at", first + 1))
        steps = F.transform(F.sequence(F.lit(0), F.lit(TRIED + 1)), lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / (TRIED + 1))
        near = (F.col("_hi") - F.col("_lo")) * F.col("_top") < F.col("_lo") * F.col("_hi")
        after = next_.select("_s", "_top", "_most", near.alias("_done"), steps.alias("_at"), F.col("_hi").alias("_d")).unionByName(now.where("_done"))
        after = scratch.write(after, "bounds")
        scratch.drop(now)
        now = after
    return now.select("_s", "_d")


def _shares(shards: DataFrame, scratch: Scratch) -> DataFrame:
    """_s, _k, _seats: of shards (source, _shard, t, m, _blocks of the source) the blocks that each gets."""
    of = _divisors(shards, scratch)
    rows = shards.join(of, shards["source"].eqNullSafe(of["_s"]))
    return _seats(rows, ["source"], ["_shard"], "_blocks").select("_s", F.col("_shard").alias("_k"), F.col("seats").cast("double").alias("_seats"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes (source, source_size, docs) and target. Sources take the weights in turn by code point, null last.

    The table has a row per source, and is ordered as a whole.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = sizes.withColumn("_n", turn).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") - 1) % len(weights) + 1)).withColumn("_cap", F.col("source_size") * F.lit(cap))
    everything, before = Window.partitionBy(), Window.orderBy(F.col("_cap") / F.col("_w"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    rows = rows.withColumn("_level", level).withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
    # the level is that of the first source, from the most easily filled on, which its share doesn't overfill
    found = F.min_by(F.when(F.col("_fits"), F.col("_level")), F.when(F.col("_fits"), F.struct(F.col("_cap") / F.col("_w"), F.col("_n")))).over(everything)
    return rows.withColumn("target", F.least(F.col("_cap"), F.coalesce(found, F.col("_level")) * F.col("_w"))).select("source", "source_size", "docs", "target")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    shard_docs: int = SHARD_DOCS,
    seed: str = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (and the columns in keep).

    size counts words (null text: 0). A source's taken words differ from its target by less than a block for each of its
    shards. No document is taken more than cap times, words in a further partial round come from its start. Null sources
    are a source; null and repeated ids are rows like others (ties in the seeded order go by id, size and text, equal rows
    are interchangeable); no rows give no rows. Reruns agree, as order and shards come from hashes of seed and id.
    """
    scratch, keep = Scratch(docs.sparkSession, "mixing"), keep or []
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_source"), words(F.col(text)).alias("size"), *(F.col(k).alias(f"_kept_{k}") for k in keep))
    rows = rows.withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit("")))))
    # the texts are read here, and once more only if they are kept
    sized = scratch.write(rows.select("_id", "_source", "size", "_order"), "sized")
    rows = rows if keep else sized
    by_source = scratch.write(targets(sized.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), weights, share, cap), "sources")
    total = by_source.agg(F.sum("source_size")).first()[0] or 0
    claims = by_source.select("*", F.col("target").alias("t"), F.floor(F.col("source_size") * F.lit(cap) / block).cast("double").alias("m"), F.floor(F.lit(total * share / block + 0.5)).cast("double").alias("_give"))
    quotas = _seats(claims, [], ["source"], "_give").select("source", "source_size", "target", F.col("seats").cast("double").alias("_blocks"), F.ceil(F.greatest(F.col("source_size") / shard_words, F.col("docs") / shard_docs, F.lit(1))).alias("_shards"))
    quotas = scratch.write(quotas, "quotas")

    def sharded(df: DataFrame) -> DataFrame:
        return df.join(quotas, df["_source"].eqNullSafe(quotas["source"])).withColumn("_shard", F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") % F.col("_shards"))

    shards = sharded(sized).groupBy("source", "_shard").agg(F.sum("size").alias("_words"), F.first("_blocks").alias("_blocks"))
    shards = scratch.write(shards.select("*", F.col("_words").cast("double").alias("t"), F.floor(F.col("_words") * F.lit(cap) / block).cast("double").alias("m")), "shards")
    seats = _shares(shards, scratch)
    shards = shards.join(seats, shards["source"].eqNullSafe(seats["_s"]) & (shards["_shard"] == seats["_k"])).select("_s", "_k", "_words", (F.col("_seats") * block).cast("long").alias("_take"))
    shards = scratch.write(shards, "shares")
    rows = sharded(rows).drop("_blocks", "_shards")
    rows = rows.join(shards, rows["source"].eqNullSafe(shards["_s"]) & (rows["_shard"] == shards["_k"]))
    ordered = Window.partitionBy("source", "_shard").orderBy("_order", "_id", "size", *(F.xxhash64(f"_kept_{k}") for k in keep))
    start = F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    rounds = F.when(F.col("_words") > 0, F.floor(F.col("_take") / F.col("_words"))).otherwise(0)
    rows = rows.withColumn("_start", start).withColumn("_rounds", rounds)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_take") - F.col("_rounds") * F.col("_words") - F.col("_start")))
    taken = (F.col("_rounds") * F.col("size") + part).cast("long")
    return rows.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), *(F.col(f"_kept_{k}").alias(f"_kept_{k}") for k in keep))


def materialise(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, repeated as often as they are taken, in docs' columns.

    A document taken once or twice is one or two rows. Where a round takes part of it, that row's text is its first words,
    joined by spaces (and n_chars, if there is such a column, is that text's length); one document in a shard is so cut.
    Null and wordless texts have nothing to take, so they go; ties and repeated rows are as in mix().
    """
    named = docs.columns
    rows = mix(docs, keep=named, **options)
    size, taken = F.col("size"), F.col("taken")
    copies = F.when(size > 0, F.ceil(taken / size)).otherwise(0)
    rows = rows.where(taken > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).withColumn("_cut", F.when(F.col("_copy") * size > taken, taken % size).cast("int"))
    text = options.get("text", "text")
    split = F.filter(F.split(F.col(f"_kept_{text}"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.when(F.col("_cut").isNull(), F.col(f"_kept_{text}")).otherwise(F.array_join(F.slice(split, F.lit(1), F.coalesce("_cut", F.lit(0))), " "))
    rows = rows.withColumn("_cut_text", cut)
    out = {n: F.col(f"_kept_{n}") for n in named} | {text: F.col("_cut_text")}
    if "n_chars" in named:
        out["n_chars"] = F.when(F.col("_cut").isNull(), F.col("_kept_n_chars")).otherwise(F.length("_cut_text").cast("long"))
    return rows.select(*(c.alias(n) for n, c in out.items()))


#: The same mix by another path: blocks are listed one by one and ranked by quotient.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, '')) AS ord
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs,
         row_number() OVER (ORDER BY source NULLS LAST) AS n
  FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((n - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM src),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed),
lvl AS (SELECT level FROM levels WHERE level * w <= cap ORDER BY cap / w, n LIMIT 1),
target AS (
  SELECT *, least(cap, (SELECT level FROM lvl) * w) AS target,
         floor(sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE / 4 + 0.5)::BIGINT AS give,
         ceil(greatest(source_size / 1048576.0, docs / 65536.0, 1))::BIGINT AS shards
  FROM levels),
blocks AS (SELECT source, n, give, target / (2 * k + 1) AS q FROM target, range(0, (cap / 4)::BIGINT + 1) r(k) WHERE k < floor(cap / 4)),
quotas AS (SELECT source, count(*) AS blocks FROM (SELECT *, row_number() OVER (ORDER BY q DESC, n) AS r FROM blocks) WHERE r <= give GROUP BY source),
dealt AS (
  SELECT s.*, t.source_size, t.target, ('0x' || substr(ord, 1, 8))::BIGINT % t.shards AS shard
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source),
shard AS (SELECT source, shard, sum(size)::BIGINT AS words FROM dealt GROUP BY source, shard),
shard_blocks AS (SELECT source, shard, words / (2 * k + 1.0::DOUBLE) AS q FROM shard, range(0, words) r(k) WHERE k < floor(words * 2.0 / 4)),
shares AS (
  SELECT b.source, b.shard, count(*) * 4 AS take
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard) AS r FROM shard_blocks) b
  JOIN quotas q ON b.source IS NOT DISTINCT FROM q.source WHERE r <= q.blocks GROUP BY b.source, b.shard),
placed AS (
  SELECT d.*, s.words, coalesce(h.take, 0) AS take,
         sum(d.size) OVER (PARTITION BY d.source, d.shard ORDER BY ord, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM dealt d JOIN shard s ON d.source IS NOT DISTINCT FROM s.source AND d.shard = s.shard
  LEFT JOIN shares h ON d.source IS NOT DISTINCT FROM h.source AND d.shard = h.shard)
SELECT doc_id, size, source_size, target,
       (CASE WHEN words > 0 THEN (take // words) * size + greatest(0, least(size, take - (take // words) * words - start)) ELSE 0 END)::BIGINT AS taken
FROM placed
"""
