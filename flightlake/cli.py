"""Command line: query, aggregate, ingest, frames, plot data, demos, benchmarks."""

from __future__ import annotations

import argparse
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlake import benchmark
from flightlake import settings as S
from flightlake.plans import plot
from flightlake.plans.store import RunStore
from flightlake.sources import export, layout, takeoff
from flightlake.streaming import ingest

# The ranges that the linear demo runs through, by parameter.
DEMO_RANGES = {
    "BaroAltitude": (0.0, 8_000.0),
    "RadioAltitude": (200.0, 7_200.0),
    "IAS": (120.0, 340.0),
    "TAS": (140.0, 370.0),
    "GroundSpeed": (135.0, 360.0),
    "VerticalSpeed": (-1_500.0, 2_500.0),
    "PitchAngle": (-4.0, 9.0),
    "RollAngle": (-20.0, 25.0),
    "YawAngle": (-8.0, 12.0),
    "Engine1_N1": (58.0, 96.0),
}
LIVE_SECONDS = 120.0


def parse_ids(text: str) -> set[int] | None:
    """Blank: no filter; a comma list: a set, empty for a lone comma."""
    if not text.strip():
        return None
    return {int(x) for x in text.split(",") if x.strip()}


def _numbers(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


def parser() -> argparse.ArgumentParser:
    conf = S.load()
    p = argparse.ArgumentParser(prog="flightlake")
    p.add_argument("--store", default=f"{conf.data_dir}/store")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict]) -> None:
        c = sub.add_parser(name)
        for flag, how in options:
            c.add_argument(flag, **how)

    number, text, on = (lambda d: {"type": int, "default": d}), (lambda d: {"default": d}), {"action": "store_true"}
    need = lambda kind: {"type": kind, "required": True}
    flt = ("--flt-file", {"default": f"{conf.data_dir}/base_flt.json"})
    made = [("--duration", {"type": float, "default": 3.0}), ("--hz", number(conf.hz)), ("--seed", number(42)), ("--stress", on), flt]
    window = [("--start-ts-ns", need(int)), ("--end-ts-ns", need(int)), ("--parameter-ids", text("")), ("--output-csv", text(""))]
    per_second, seed, out = ("--samples-per-second", number(4)), ("--seed", number(42)), ("--output-json", text(""))
    block = ("--block-max-points", number(conf.storage.sstable_block_max_points))
    queue = [("--queue-max-frames", number(conf.ingest.queue_max_frames)), ("--batch-max-rows", number(conf.ingest.batch_max_rows)), ("--batch-max-points", number(conf.ingest.batch_max_points))]
    command("query", *window)
    command("aggregate", *window)
    command("ingest", ("--frames", text("")), ("--checkpoint", text("")), ("--print-stats", on), *made)
    command("printer", *made)
    command("plot-flight", ("--target-seconds", need(float)), flt)
    command("plot-flight-demo", ("--target-seconds", need(float)), per_second, flt)
    command("plot-flight-live", per_second, flt)
    command("benchmark", seed, ("--rows", number(4096)), ("--parameter-pool", number(32)), ("--points-per-row", number(8)), ("--sweep", {"type": _numbers, "default": [256, 512, 1024, 2048, 4096]}), block, out)
    command("benchmark-scale", seed, ("--rows", number(512)), ("--parameter-pools", {"type": _numbers, "default": [200, 500, 1000, 3000]}), block, out)
    command("benchmark-capture", seed, ("--frames", number(512)), ("--parameter-pool", number(3000)), ("--points-per-frame", number(3000)), *queue, block, out)
    command("compact")
    return p


def _ids(flt: DataFrame) -> dict[str, int]:
    """Ids by name; of equal names the later counts. The layout is a validated dimension in one file."""
    return {r["name"]: r["parameter_id"] for r in flt.select("name", "parameter_id").collect()}


def _print(lines) -> None:
    for line in lines:
        print(line)


def _plot(points: DataFrame, flt: DataFrame, target: float) -> None:
    named = points.join(flt.select("parameter_id", "name"), "parameter_id")
    plot.check(named, [r["name"] for r in flt.select("name").collect()], target, takeoff.NAMES)
    _print(export.lines(plot.scaled_series(named, target).orderBy("name", F.col("seconds"))))
    _print(export.lines(plot.guides(named, target).orderBy("band", F.desc("fraction")).withColumn("series", F.replace("series", F.lit("\n"), F.lit("; ")))))


def _shared(spark: SparkSession, home: str) -> str:
    """A folder that driver and executors share; one of this machine only where all of Spark runs on it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found or f"file://{home}"


def _generated(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return layout.generate_frames(spark, layout.read_layout(spark, args.flt_file), int(args.duration * args.hz), args.hz, args.seed, args.stress)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "printer":
        _print(export.lines(_generated(spark, args).orderBy("seq", "parameter_id")))
    elif args.command == "plot-flight-demo":
        flt = layout.read_layout(spark, args.flt_file)
        ids = _ids(flt)
        if missing := sorted(set(DEMO_RANGES) - set(ids)):
            raise ValueError("missing parameters: " + ", ".join(missing))
        _plot(layout.linear_series(spark, [(ids[n], *r) for n, r in DEMO_RANGES.items()], args.target_seconds, args.samples_per_second), flt, args.target_seconds)
    elif args.command == "plot-flight-live":
        flt = layout.read_layout(spark, args.flt_file)
        _plot(takeoff.takeoff_series(spark, _ids(flt), LIVE_SECONDS, args.samples_per_second), flt, LIVE_SECONDS)
    elif args.command.startswith("benchmark"):
        with tempfile.TemporaryDirectory() as local:
            root, block = _shared(spark, local), args.block_max_points or None
            if args.command == "benchmark":
                figures = benchmark.suite(spark, root, args.seed, args.rows, args.parameter_pool, args.points_per_row, args.sweep, block)
            elif args.command == "benchmark-scale":
                figures = benchmark.scale(spark, root, args.seed, args.rows, tuple(args.parameter_pools), block)
            else:
                # A file is a batch; the queue holds as many batches as have room in it.
                frames = max(1, min(x for x in (args.frames, args.batch_max_rows, args.batch_max_points // max(1, args.points_per_frame)) if x > 0))
                figures = benchmark.capture(spark, root, args.seed, args.frames, args.parameter_pool, args.points_per_frame, -(-args.frames // frames), max(1, args.queue_max_frames // frames), block)
            _print(benchmark.summary(figures))
            report = benchmark.report(figures, args.output_json)
            if not args.output_json:
                print(report)
    else:
        conf = S.load()
        S.set_up_logging(conf)
        if "://" not in args.store:
            args.store = f"file://{os.path.abspath(args.store)}"
        with RunStore(spark, args.store, conf.storage.compaction_min_tables, conf.storage.sstable_block_max_points) as store:
            _on_store(spark, store, args)
    return 0


def _printer():
    """Prints what a batch brought, with rates over the time since the last."""
    statistics, last = ingest.Statistics(), [time.perf_counter()]

    def show(found: dict) -> None:
        now = time.perf_counter()
        print(statistics.line(found, now - last[0]))
        last[0] = now

    return show


def _on_store(spark: SparkSession, store: RunStore, args: argparse.Namespace) -> None:
    if args.command in ("query", "aggregate"):
        ids, points = parse_ids(args.parameter_ids), args.command == "query"
        out = (store.query_range if points else store.aggregate_range)(args.start_ts_ns, args.end_ts_ns, ids)
        out = out if points else out.orderBy("parameter_id")
        if args.output_csv:
            (export.write_points_csv if points else export.write_aggregates_csv)(out, args.output_csv)
        else:
            _print(export.lines(out))
    elif args.command == "ingest" and args.frames:
        ingest.ingest(ingest.read_frames(spark, args.frames), store, args.checkpoint or f"{args.store}/checkpoint", _printer() if args.print_stats else None).awaitTermination()
    elif args.command == "ingest":
        flt, report = layout.read_layout(spark, args.flt_file), _printer()
        found = ingest.replay(store, layout.whole_frames(spark, flt, int(args.duration * args.hz), args.hz, args.seed, args.stress), S.load())
        if args.print_stats:
            report(found)
    elif args.command == "compact":
        print(store.compact())
    else:
        _plot(store.query_range(0, (1 << 63) - 1), layout.read_layout(spark, args.flt_file), args.target_seconds)


if __name__ == "__main__":
    raise SystemExit(main())
