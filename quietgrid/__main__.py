"""The engine from a command line.

python -m quietgrid list                                             names of the queries
python -m quietgrid run NAME --data DIR [--out PATH]                 a query over the tables in a folder
python -m quietgrid record --cache DIR --out PATH --frames N         the first frames of a stream of cached videos
python -m quietgrid fit --rows PARQUET --model PATH --dim N          a background, learned and saved
python -m quietgrid watch --rows PARQUET --model PATH --calibration PARQUET --out PATH   a saved background over a stream: alarms
python -m quietgrid evaluate --scores PARQUET --labels PARQUET       AUC and equal error rate of each detector
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import registry
from .session import ship
from .sources.sinks import markdown


def _session(name: str) -> SparkSession:
    return ship(SparkSession.builder.appName(f"quietgrid {name}").getOrCreate())


def _show(result: DataFrame, out: str | None, rows: int) -> None:
    if out:
        result.write.mode("overwrite").parquet(out)
    else:
        print(markdown(result, rows))


def _run(args: argparse.Namespace) -> None:
    _show(registry.QUERIES[args.name](_session(args.name), args.data), args.out, args.rows)


def _record(args: argparse.Namespace) -> None:
    from .sources.cache import FrameCache
    from .streaming.recording import record

    spark = _session("record")
    spark.dataSource.register(FrameCache)
    stream = spark.readStream.format("frame_cache").option("every", args.every).option("rate", args.rate).option("begin", args.begin).load(args.cache)
    n = record(stream, args.out, args.frames, ["scene", "split", "video", "t"], args.checkpoint or f"{args.out}-checkpoint", processingTime=f"{args.seconds} seconds")
    print(f"{n} frames in {args.out}")


def _fit(args: argparse.Namespace) -> None:
    from .models import BackgroundEstimator

    BackgroundEstimator(dim=args.dim).fit(_session("fit").read.parquet(args.rows)).write().overwrite().save(args.model)


def _watch(args: argparse.Namespace) -> None:
    """Rows have id, video, t, cell and f. The threshold comes from the calibration rows, which are normal ones."""
    from .models import BackgroundModel
    from .streaming.live import calibrated_threshold, causal_alarms
    from .streaming.recording import read_batches, write_alarms

    spark = _session("watch")
    model = BackgroundModel.load(args.model)
    scored = lambda d: model.transform(d).withColumnRenamed(args.detector, "score")
    calibration = spark.read.parquet(args.calibration)
    cut = calibrated_threshold(scored(calibration), "video", "t", "id", "score", args.quantile, args.median)
    alarms = causal_alarms(scored(spark.readStream.schema(calibration.schema).parquet(args.rows)), "video", "t", "id", "score", cut, args.median)
    write_alarms(alarms, args.out, args.checkpoint or f"{args.out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    kinds = ", ".join(f"{n} {k}" for n, k in alarms.dtypes)
    print(f"threshold {cut:.4g}: {read_batches(spark, args.out, kinds).count()} alarms in {args.out}")


def _evaluate(args: argparse.Namespace) -> None:
    """Scores have det, video, t and score; labels video, t and y. Frames without a label are left out."""
    from .operators.metrics import auc, equal_error_rate
    from .session import checkpointed

    spark = _session("evaluate")
    rows = checkpointed(spark.read.parquet(args.scores).join(spark.read.parquet(args.labels).select("video", "t", F.col("y").cast("int").alias("y")), ["video", "t"]))
    _show(auc(rows, "score", "y", ["det"]).join(equal_error_rate(rows, "score", "y", ["det"]), "det").orderBy(F.desc("auc")), args.out, args.rows)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quietgrid", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="run a query over the tables in a folder")
    run.add_argument("name", choices=sorted(registry.QUERIES))
    run.add_argument("--data", required=True)
    record = commands.add_parser("record", help="record the first frames of a stream of cached videos")
    record.add_argument("--cache", required=True)
    record.add_argument("--frames", type=int, required=True)
    record.add_argument("--every", type=int, default=1, help="keep each n-th frame")
    record.add_argument("--rate", type=float, default=0, help="frames a second of each video; 0: all are there")
    record.add_argument("--begin", type=float, default=0, help="when videos begin, in seconds since 1970")
    record.add_argument("--seconds", type=float, default=1, help="between micro-batches")
    fit = commands.add_parser("fit", help="learn a background and save it")
    fit.add_argument("--rows", required=True)
    fit.add_argument("--model", required=True)
    fit.add_argument("--dim", type=int, required=True)
    watch = commands.add_parser("watch", help="alarms of a stream under a saved background")
    watch.add_argument("--rows", required=True)
    watch.add_argument("--model", required=True)
    watch.add_argument("--calibration", required=True)
    watch.add_argument("--detector", default="frx_global")
    watch.add_argument("--quantile", type=float, default=0.995)
    watch.add_argument("--median", type=int, default=9)
    evaluate = commands.add_parser("evaluate", help="measures of scores against labels")
    evaluate.add_argument("--scores", required=True)
    evaluate.add_argument("--labels", required=True)
    for command in (run, evaluate):
        command.add_argument("--out", help="write Parquet there; otherwise rows are printed")
        command.add_argument("--rows", type=int, default=20, help="rows to print")
    for command in (record, watch):
        command.add_argument("--out", required=True)
        command.add_argument("--checkpoint", help="the stream's checkpoint; by default beside --out")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
    else:
        {"run": _run, "record": _record, "fit": _fit, "watch": _watch, "evaluate": _evaluate}[args.command](args)


if __name__ == "__main__":
    main()
