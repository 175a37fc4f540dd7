"""Shared helpers: tables, scratch space that executors share, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch between Spark and Python: texts are long, and several copies of a batch are held at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch limits to those above, where they are higher."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > most or int(now.rstrip("b")) <= 0:
            spark.conf.set(key, str(most))


#: Folders that this process has written and not released.
_ROOTS: set[str] = set()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held() -> frozenset[str]:
    """The folders of scratch tables that this process has written and not released."""
    return frozenset(_ROOTS)


def release(spark: SparkSession, but: frozenset[str] = frozenset()) -> None:
    """Deletes all scratch tables of this process but those in some folders.

    Results of operators read them, so those must have been written before.
    """
    for root in _ROOTS - but:
        _delete(spark, root)
        _ROOTS.discard(root)


class Scratch:
    """Tables written to the shared folder. They cut lineage and outlive the executor that wrote them; release() deletes them."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.n = spark, 0
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _ROOTS.add(self.root)

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        df.write.parquet(path := self.path(name))
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that write() returned; nothing lazy may still read it."""
        _delete(self.spark, df.scratch_path)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of an undirected graph.

    edges: columns a and b of one orderable type, repeats and either direction allowed. Returns (id, component) for every
    node of an edge with a != b, component being the smallest id reachable. Alternates large-star and small-star steps
    (logarithmically many rounds) until only stars are left; every round is two grouped minima with map-side combine and two
    equi-joins, so a hub with any number of links is never gathered in one task. Rounds are written to the shared folder.
    Null ends are ignored.
    """
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _settled(now):
        least = now.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
        large = now.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        after = scratch.write(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct(), "edges")
        scratch.drop(now)
        now = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether every node u has one edge and is no other edge's v. edges: distinct (u, v), u > v."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up")))
    return ends.groupBy("id").agg(F.max("up").alias("up"), F.count("*").alias("n")).where("up = 1 and n > 1").count() == 0


def joined(found: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """components() of a graph with further edges (columns a and b), given found, its components() without them.

    Only the components that the further edges link are worked on. Null ends are ignored.
    """
    a, b = (found.select(F.col("id").alias(k), F.col("component").alias(f"_{k}")) for k in "ab")
    ends = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    above = components(ends, scratch)
    old = found.join(above.select(F.col("id").alias("component"), F.col("component").alias("_above")), "component", "left")
    return old.select("id", F.coalesce("_above", "component").alias("component")).unionByName(above.join(found, "id", "left_anti"))
