"""Makes this package importable on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files, once per Spark context."""
    sc = spark.sparkContext
    if not getattr(sc, "_quietgrid_shipped", False):
        here = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="quietgrid-py-"), "quietgrid_package.zip")
        with zipfile.ZipFile(path, "w") as out:
            for p in sorted(here.rglob("*.py")):
                out.write(p, Path("quietgrid") / p.relative_to(here))
        sc.addPyFile(path)
        sc._quietgrid_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only on a local master, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quietgrid-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage and written to the shared folder, so that it outlives the executors that made it; release() deletes it."""
    path = folder(df.sparkSession, "checkpoint")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """df written to the shared folder and read from there, for work that reads it again and again; deleted when the block ends.

    Nothing lazy that reads it may leave the block.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        delete(spark, path)


#: Folders of tables that results read, and that may go when those have been written.
_FOLDERS: set[str] = set()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one; release() deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.add(path)
    return path


def release(spark: SparkSession) -> None:
    """Deletes the folders that this process has named, once results that read them have been written."""
    for path in list(_FOLDERS):
        delete(spark, path)
        _FOLDERS.discard(path)
