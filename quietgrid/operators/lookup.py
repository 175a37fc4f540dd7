"""Joins of many rows with a table of parameters: the table is broadcast if it is small, and dealt to several tasks a key if not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed

#: Bytes of a table up to which it is broadcast; tasks that share a key's rows beyond that.
BROADCAST, SALTS = 32 << 20, 32


def width(table: DataFrame):
    """Bytes of a row, about: 8 for a number or a flag, what strings and binaries are, 8 for an element of an array."""
    parts = [F.lit(8 * len(table.columns))]
    for f in table.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            parts.append(F.coalesce(F.size(f.name), F.lit(0)) * 8)
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(f.name), F.lit(0)))
    return sum(parts[1:], parts[0]).cast("long")


def measured(table: DataFrame) -> int:
    """Bytes of a table, about. The table should be a kept one, as this is a job over it."""
    return table.agg(F.sum(width(table))).first()[0] or 0


def joined(rows: DataFrame, table: DataFrame, keys: list[str], size: int, how: str = "inner", limit: int = BROADCAST, salts: int = SALTS) -> DataFrame:
    """rows joined (inner or left) with the table's one row for their keys, given the table's size in bytes.

    Up to `limit` bytes the table is broadcast, so rows stay where they are. Beyond that each of its rows is repeated for
    `salts` parts of a key, over which rows are spread by a hash of their columns: rows of a hot key go to as many tasks.
    """
    if size <= limit:
        return rows.join(F.broadcast(table), keys, how)
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = [c for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"]
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*own), F.lit(salts)).cast("int")).join(spread.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", limit: int = BROADCAST, salts: int = SALTS) -> DataFrame:
    """joined() with a table that is worked out once, written to the shared folder and measured there. rows may be a stream."""
    table = checkpointed(table)
    return joined(rows, table, keys, measured(table), how, limit, salts)
