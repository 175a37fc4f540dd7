"""Interpolated Kneser-Ney models of words, as tables of counts, and the log-odds of texts under two of them.

A model of order n has for each order k up to n a table of (context of k - 1 words, word) with a count: of occurrences for
the whole order, of different words before for the lower ones. A probability is the discounted share of the count, and what
discounts leave goes to the next lower order; below the last there is one share for each word of a common vocabulary and
one for all unknown words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: What is taken off every count; what stands before the first and after the last word; a word.
DISCOUNT, BEGIN, END, WORD = 0.75, "<s>", "</s>", "[a-z]+"


def words(text: Column) -> Column:
    """Lower-cased words in order; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def grams(df: DataFrame, ids: list[str], text: str, order: int) -> DataFrame:
    """ids, ctx, w, n: each record's n-grams with how often it has them. Texts begin after order - 1 marks and end with one."""
    marked = F.concat(F.array_repeat(F.lit(BEGIN), order - 1), words(F.col(text)), F.array(F.lit(END)))
    # shifted copies side by side: a slice made for each word would copy the text each time
    last = F.size("_w") - (order - 1)
    shifted = F.arrays_zip(*(F.slice("_w", i + 1, last).alias(f"w{i}") for i in range(order)))
    parts = [F.col(f"g.w{i}") for i in range(order)]
    rows = df.select(*ids, marked.alias("_w")).select(*ids, F.explode(shifted).alias("g")).select(*ids, F.concat_ws(" ", *parts[:-1]).alias("ctx"), parts[-1].alias("w"))
    return rows.groupBy(*ids, "ctx", "w").agg(F.count("*").alias("n"))


def counts(training: DataFrame, text: str, order: int) -> list[DataFrame]:
    """Tables (ctx, w, c) of the orders 1 to `order`, in the shared folder: texts are read and n-grams counted once, and lower
    orders come from the distinct ones above."""
    tables = [checkpointed(grams(training, [], text, order).withColumnRenamed("n", "c"))]
    for _ in range(order - 1):
        above = tables[0]
        shorter = F.when(F.instr("ctx", " ") > 0, F.regexp_replace("ctx", "^[^ ]* ", "")).otherwise(F.lit(""))
        tables.insert(0, checkpointed(above.select(shorter.alias("ctx"), "w").groupBy("ctx", "w").agg(F.count("*").alias("c"))))
    return tables


def contexts(table: DataFrame, ctx: str = "ctx") -> DataFrame:
    """ctx, total, kinds: of a table of counts, the sum and the number of words after each context."""
    return table.groupBy(ctx).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))


def probabilities(asked: DataFrame, tables: list[DataFrame], vocabulary: DataFrame, out: str, discount: float = DISCOUNT) -> DataFrame:
    """asked (distinct ctx, w of the whole order) with the probability of w after ctx.

    vocabulary: one row, `size`: words that any model of a comparison knows; one more share is for all others. Of the tables
    only what is asked for is shuffled.
    """
    order = len(tables)
    rows = asked.crossJoin(F.broadcast(vocabulary)).withColumn(out, 1.0 / (F.col("size") + 1)).drop("size")  # one row
    for k, table in enumerate(tables, 1):
        own = F.lit("") if k == 1 else F.substring_index("ctx", " ", -(k - 1)) if k < order else F.col("ctx")
        rows = rows.withColumn("_ctx", own)
        table = table.withColumnRenamed("ctx", "_ctx")
        wanted = asked.select(own.alias("_ctx"), "w")
        known = table.join(wanted.distinct(), ["_ctx", "w"], "left_semi").withColumnRenamed("c", "_c")
        totals = contexts(table.join(wanted.select("_ctx").distinct(), ["_ctx"], "left_semi"), "_ctx")
        rows = rows.join(known, ["_ctx", "w"], "left").join(totals, ["_ctx"], "left")
        share = (F.greatest(F.coalesce("_c", F.lit(0)) - discount, F.lit(0.0)) + discount * F.col("kinds") * F.col(out)) / F.col("total")
        rows = rows.withColumn(out, F.when(F.col("total").isNull(), F.col(out)).otherwise(share)).drop("_ctx", "_c", "total", "kinds")
    return rows


def log_odds(records: DataFrame, one: DataFrame, other: DataFrame, ids: list[str], text: str, order: int = 2, out: str = "score") -> DataFrame:
    """ids, words, out: the mean over a record's words and its end of ln(p of one / p of other), models of two sets of texts.

    Above 0 a record is more like the texts of `one`. Every distinct n-gram of the records is looked up once in each model;
    records of no words have their end alone. A null text is an empty one; an empty set of texts knows nothing, so all words
    have one probability. Rows that share ids are one record.
    """
    models = [counts(t, text, order) for t in (one, other)]
    known = models[0][0].select("w").union(models[1][0].select("w")).distinct().agg(F.count("*").alias("size"))
    own = checkpointed(grams(records, ids, text, order))
    asked = checkpointed(own.select("ctx", "w").distinct())
    for tables, name in zip(models, ("_one", "_other"), strict=True):
        asked = probabilities(asked, tables, known, name)
    odds = asked.select("ctx", "w", F.ln(F.col("_one") / F.col("_other")).alias("_odds"))
    return own.join(odds, ["ctx", "w"]).groupBy(*ids).agg((F.sum("n") - 1).alias("words"), (F.sum(F.col("n") * F.col("_odds")) / F.sum("n")).alias(out))
