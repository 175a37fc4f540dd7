"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """Parquet, in folders by the named columns, so that scans of a scene or split read their folders alone."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines."""
    df.write.mode(mode).json(path)


def _write_documents(documents: DataFrame, root: str) -> int:
    """Writes each row's text to the file that its path names below root, complete or not at all; returns how many there are."""
    import uuid
    from collections.abc import Iterator

    import pyarrow as pa
    import pyarrow.fs

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        done = 0
        for batch in batches:
            for path, text in zip(batch["path"].to_pylist(), batch["text"].to_pylist(), strict=True):
                folder = f"{base}/{path}".rsplit("/", 1)[0]
                fs.create_dir(folder, recursive=True)
                at = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(at) as out:
                    out.write(text.encode())
                fs.move(at, f"{base}/{path}")
                done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["done"])

    return documents.select("path", "text").mapInArrow(task, "done long").agg(F.sum("done")).first()[0] or 0


def write_labels(labels: DataFrame, root: str) -> int:
    """scene, video, t, y to `<root>/<scene>/gt.json`, {video: [0, 1, ...]}, which read_labels() takes back; returns the scenes.

    A scene's labels are one document, so they meet in one task; t numbers a video's frames without gaps.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda s: s["y"].cast("int"))
    scenes = labels.groupBy("scene", "video").agg(ordered.alias("y")).groupBy("scene").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("video", "y")))).alias("m"))
    return _write_documents(scenes.select(F.concat("scene", F.lit("/gt.json")).alias("path"), F.to_json("m").alias("text")), root)


def write_results(results: DataFrame, root: str, name: str = "eval") -> int:
    """run, detector, post, auc, eer to `<root>/<run>/<name>/results.json`, which read_results() takes back; returns the runs."""
    entry = F.struct(F.concat_ws("/", "detector", "post").alias("key"), F.struct("auc", "eer").alias("value"))
    runs = results.groupBy("run").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("auc"))
    return _write_documents(runs.select(F.concat("run", F.lit(f"/{name}/results.json")).alias("path"), F.to_json(F.struct("auc")).alias("text")), root)


def pivot_table(results: DataFrame, rows: str, columns: str, value: str, names: list[str] | None = None) -> DataFrame:
    """A table with a column for each of names (or each value found), rounded for print."""
    grouped = results.groupBy(rows).pivot(columns, names) if names else results.groupBy(rows).pivot(columns)
    return grouped.agg(F.round(F.max(value), 4)).orderBy(rows)


def markdown(table: DataFrame, limit: int = 200) -> str:
    """A small table as Markdown: a report, of `limit` rows at most."""
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in table.limit(limit).collect()])
