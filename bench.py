"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from flightlake import queries  # noqa: E402
from flightlake.operators import points as P  # noqa: E402
from flightlake.plans.store import RunStore  # noqa: E402

HEADLINE = ["query_range_all", "query_range_ids", "newest_wins_runs", "aggregate_range_all", "aggregate_range_ids_fill", "compact_runs", "block_assign", "ts_deltas", "plot_scaled", "frame_flatten", "bench_narrow", "bench_wide"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}

    def timed(name: str, run, repeats: int = 2) -> float:
        best = None
        for _ in range(repeats):  # the first run also compiles code
            began = time.perf_counter()
            run()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        times[name] = round(best, 4)
        return best

    for name in HEADLINE:
        if name != "frame_flatten":
            timed(name, lambda n=name: queries.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save())
    points = queries.versioned(spark, sf_dir).drop("run_id")
    n = points.count()
    with tempfile.TemporaryDirectory() as home:  # all of Spark runs on this machine
        queries._frames(spark, sf_dir).write.parquet(f"file://{home}/frames")
        frames = spark.read.parquet(f"file://{home}/frames")  # the fixture is made once, the operator is timed
        timed("frame_flatten", lambda: P.flatten_rows(P.normalise_frames(frames)).write.format("noop").mode("overwrite").save())
        store = RunStore(spark, f"file://{home}/store", min_runs=2)
        ingest = timed("store_ingest", lambda: store.append(points))
        scan = timed("store_wide_query", lambda: store.query_range(0, 1 << 62).write.format("noop").mode("overwrite").save())
        timed("store_narrow_query", lambda: store.query_range(queries.START, queries.START + 8 * queries.HOUR, [1]).write.format("noop").mode("overwrite").save())
        timed("store_compact", store.compact, 1)  # again there would be nothing to compact
        timed("store_reopen", lambda: RunStore(spark, f"file://{home}/store").manifest())
        size = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{home}/store/runs") for f in fs if f.endswith(".parquet"))
        written = sum(r["point_count"] for r in store.manifest()["runs"])
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir, "points": n, "ingest_points_per_sec": round(n / ingest), "wide_points_per_sec": round(n / scan), "store_bytes": size, "live_points": written}))
    spark.stop()


if __name__ == "__main__":
    main()
