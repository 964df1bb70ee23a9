"""The engine's own benchmark: scenarios over a run store, a scale suite, a capture test, a sweep.

Every scenario works on a new store under ``root`` (a folder all of Spark can reach) and
returns a flat dict of figures; ``report`` writes them as JSON.
"""

from __future__ import annotations

import json
import platform
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlake.plans.store import RunStore

BASE_NS, STEP_NS = 1_700_000_000_000_000_000, 125_000_000
Spec = tuple[int, int, list[int]]


def _unit(*of) -> F.Column:
    """Uniform in [0, 1) by a hash."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 40)) / float(1 << 40)


def dataset(spark: SparkSession, seed: int, rows: int, pool: int, per_row: int) -> DataFrame:
    """(row, timestamp_ns, parameter_id, value): about ``per_row`` different ids of ``pool`` at each of ``rows`` times.

    A row has ``per_row`` give or take 2 ids, one at least and the pool at most; values lie
    near an eighth of the id, times jitter by an eighth of a step at most.
    """
    s = F.lit(seed)
    at = spark.range(rows).select(
        F.col("id").alias("row"),
        (F.lit(BASE_NS) + F.col("id") * STEP_NS + F.floor(_unit(s, F.lit("t"), "id") * (STEP_NS // 8))).cast("long").alias("timestamp_ns"),
        F.least(F.lit(pool), F.greatest(F.lit(1), per_row - 2 + F.floor(_unit(s, F.lit("n"), "id") * 5))).cast("int").alias("n"),
    )
    shuffled = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(pool)), lambda p: F.struct(F.xxhash64(s, "row", p).alias("h"), p.cast("long").alias("id"))))
    ids = at.select("row", "timestamp_ns", F.explode(F.slice(shuffled, F.lit(1), F.col("n"))["id"]).alias("parameter_id"))
    second = (F.col("timestamp_ns") % 1_000_000_000) / 1e9
    return ids.withColumn("value", F.round(F.col("parameter_id") * 0.125 + _unit(s, "row", "parameter_id") * 3 + second, 6))


def frames(spark: SparkSession, seed: int, count: int, pool: int, per_frame: int) -> DataFrame:
    """Frames (seq, ts_monotonic, values) an eighth of a second apart, each with ``per_frame`` ids, one at least and the pool at most."""
    n = min(pool, max(1, per_frame))
    entry = F.transform(
        F.sequence(F.lit(1), F.lit(n)),
        lambda k: F.struct(F.concat(F.lit("P"), k.cast("string")).alias("key"), F.struct(k.cast("string").alias("parameter_id"), F.round(_unit(F.lit(seed), "id", k) * 1000, 3).cast("string").alias("value")).alias("value")),
    )
    return spark.range(count).select(F.col("id").cast("string").alias("seq"), (F.col("id") * 0.125).alias("ts_monotonic"), F.map_from_entries(entry).alias("values"))


def specs(rows: int, pool: int, wide: bool) -> list[Spec]:
    """Query windows over row numbers, each with the first ids: 12 narrow or 8 wide ones."""
    widths, sizes = ([256, 384, 512, 768], [pool, max(6, pool // 2)]) if wide else ([8, 12, 16, 24], [1, 2, 3])
    starts = [min(rows - 1, k * max(1, rows // len(widths))) for k in range(len(widths))]
    ns = lambda row: BASE_NS + row * STEP_NS
    return [(ns(a), ns(min(rows - 1, a + w) + 1), list(range(1, min(n, pool) + 1))) for a, w in zip(starts, widths) for n in sizes]


def inclusive_percentile(values: list[float], q: float) -> float:
    """Linear interpolation between ranks; 0 for none."""
    if not values:
        return 0.0
    ordered = sorted(values)
    place = (len(ordered) - 1) * q
    low = int(place)
    return ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (place - low)


def _latencies(ms: list[float]) -> dict[str, float]:
    return {f"latency_p{p}_ms": round(inclusive_percentile(ms, p / 100), 3) for p in (50, 95, 99)}


def _timed(run: Callable[[], object]) -> tuple[float, object]:
    began = time.perf_counter()
    out = run()
    return max(1e-9, time.perf_counter() - began), out


def store_bytes(store: RunStore) -> int:
    """Bytes of all runs on disk."""
    return store._fs.getContentSummary(store._path("runs")).getLength()


def _new(spark: SparkSession, root: str, min_runs: int = 32, block_points: int | None = None) -> RunStore:
    return RunStore(spark, f"{root.rstrip('/')}/bench-{uuid.uuid4().hex}", min_runs=min_runs, block_points=block_points)


def _loaded(spark: SparkSession, root: str, data: DataFrame, rows: int, runs: int, block_points: int | None = None) -> RunStore:
    """A store that has ``data`` in ``runs`` appends of successive rows."""
    store, each = _new(spark, root, block_points=block_points), -(-rows // runs)
    for k in range(runs):
        store.append(data.filter(F.col("row").between(k * each, (k + 1) * each - 1)).drop("row"))
    return store


def ingest_only(spark: SparkSession, root: str, data: DataFrame, rows: int, block_points: int | None = None) -> dict:
    took, store = _timed(lambda: _loaded(spark, root, data, rows, 1, block_points))
    points, size = store.stats["flush_points"], store_bytes(store)
    return {"rows_per_sec": rows / took, "points_per_sec": points / took, "bytes_written": size, "bytes_per_point": size / max(1, points), "flush_count": store.stats["flush_count"]}


def queries(spark: SparkSession, root: str, data: DataFrame, rows: int, wanted: list[Spec], block_points: int | None = None) -> dict:
    """Latency of each query on a reopened store, and counters of pruning."""
    first = _loaded(spark, root, data, rows, 4, block_points)
    first.close()
    store, ms, returned = RunStore(spark, first.root), [], 0
    for a, b, ids in wanted:
        took, n = _timed(lambda: store.query_range(a, b, ids).count())
        ms.append(took * 1e3)
        returned += n
    return {"queries": len(ms), "queries_per_sec": len(ms) / (sum(ms) / 1e3), "points_returned": returned, **_latencies(ms), **{k: store.stats[k] for k in ("files_considered", "files_pruned", "files_opened")}}


def mixed_read_write(spark: SparkSession, root: str, data: DataFrame, rows: int, wanted: list[Spec], batches: int = 4) -> dict:
    """A writer's appends beside a reader's queries; failures are collected."""
    store, ms, failures = _new(spark, root), [], []
    each = -(-rows // batches)

    def write() -> None:
        try:
            for k in range(batches):
                store.append(data.filter(F.col("row").between(k * each, (k + 1) * each - 1)).drop("row"))
        except Exception as e:  # noqa: BLE001  reported, not hidden
            failures.append(f"writer: {e}")

    began = time.perf_counter()
    writer = threading.Thread(target=write)
    writer.start()
    for a, b, ids in wanted:
        try:
            ms.append(_timed(lambda: store.query_range(a, b, ids).count())[0] * 1e3)
        except Exception as e:  # noqa: BLE001
            failures.append(f"reader: {e}")
    writer.join()
    took = time.perf_counter() - began
    return {"elapsed_sec": took, "points_per_sec": store.stats["flush_points"] / took, "queries": len(ms), "failures": failures, **_latencies(ms)}


def frequent_flush_compact(spark: SparkSession, root: str, data: DataFrame, rows: int, batches: int = 8, min_runs: int = 4) -> dict:
    """Small appends with a compaction at every ``min_runs`` runs."""
    store, each, ms = _new(spark, root, min_runs), -(-rows // batches), []
    began = time.perf_counter()
    for k in range(batches):
        store.append(data.filter(F.col("row").between(k * each, (k + 1) * each - 1)).drop("row"))
        took, ran = _timed(store.compact)
        if ran:
            ms.append(took * 1e3)
    elapsed = time.perf_counter() - began
    return {"elapsed_sec": elapsed, "flush_count": store.stats["flush_count"], "compaction_count": store.stats["compaction_count"], "compaction_points": store.stats["compaction_points"], "compaction_duration_ms": sum(ms), "live_points": sum(r["point_count"] for r in store.manifest()["runs"])}


def cold_recovery_startup(spark: SparkSession, root: str, data: DataFrame, rows: int) -> dict:
    store = _loaded(spark, root, data, rows, 4)
    store.close()
    took, again = _timed(lambda: RunStore(spark, store.root))
    recovery, _ = _timed(again.recover)
    return {"startup_ms": took * 1e3, "recovery_ms": recovery * 1e3, "runs": len(again.manifest()["runs"]), "quarantined_runs": again.stats["quarantined_runs"]}


def suite(spark: SparkSession, root: str, seed: int = 42, rows: int = 4096, pool: int = 32, per_row: int = 8, sizes: Sequence[int] = (), block_points: int | None = None) -> dict:
    """All six scenarios over one dataset, which is written once and read again, and a sweep of block ``sizes`` if any are given."""
    home = f"{root.rstrip('/')}/data-{uuid.uuid4().hex}"
    dataset(spark, seed, rows, pool, per_row).write.parquet(home)
    data = spark.read.parquet(home)
    narrow, wide = specs(rows, pool, False), specs(rows, pool, True)
    return {
        "seed": seed, "rows": rows, "pool": pool, "total_points": data.count(), "platform": platform.platform(), "python": platform.python_version(),
        "ingest_only": ingest_only(spark, root, data, rows, block_points), "narrow_query": queries(spark, root, data, rows, narrow, block_points), "wide_query": queries(spark, root, data, rows, wide, block_points),
        "mixed_read_write": mixed_read_write(spark, root, data, rows, narrow), "frequent_flush_compact": frequent_flush_compact(spark, root, data, rows), "cold_recovery_startup": cold_recovery_startup(spark, root, data, rows),
    } | ({"sweep": sweep(spark, root, data, rows, narrow, sizes)} if sizes else {})


def scale(spark: SparkSession, root: str, seed: int = 42, rows: int = 512, pools: tuple[int, ...] = (200, 500, 1000, 3000), block_points: int | None = None) -> list[dict]:
    """Ingest and both kinds of query for growing pools, every row with the whole pool."""
    out = []
    for pool in pools:
        data = dataset(spark, seed, rows, pool, pool)
        out.append({"pool": pool, "ingest_only": ingest_only(spark, root, data, rows, block_points)} | {n: queries(spark, root, data, rows, specs(rows, pool, n == "wide_query"), block_points) for n in ("narrow_query", "wide_query")})
    return out


def capture(spark: SparkSession, root: str, seed: int = 42, count: int = 512, pool: int = 3000, per_frame: int = 3000, files: int = 8, queue_files: int = 1, block_points: int | None = None) -> dict:
    """Frames from files through the streaming ingest, ``queue_files`` at a time; the loss is what a read of the store lacks."""
    from flightlake.streaming.ingest import ingest, read_frames

    home, expected = f"{root.rstrip('/')}/capture-{uuid.uuid4().hex}", count * min(pool, max(1, per_frame))
    frames(spark, seed, count, pool, per_frame).repartition(files).write.json(f"{home}/frames")
    store = RunStore(spark, f"{home}/store", min_runs=32, block_points=block_points)
    query = ingest(read_frames(spark, f"{home}/frames", queue_files), store, f"{home}/checkpoint")
    took, _ = _timed(query.awaitTermination)
    ms = [float(p["durationMs"]["triggerExecution"]) for p in query.recentProgress if p["numInputRows"]]
    stored = store.query_range(0, (1 << 63) - 1).count()
    return {"frames": count, "points_expected": expected, "points_stored": stored, "loss_rate": (expected - stored) / max(1, expected), "frames_per_sec": count / took, "points_per_sec": stored / took, **_latencies(ms)}


def block_candidate(spark: SparkSession, root: str, data: DataFrame, rows: int, wanted: list[Spec], points: int, runs: int = 4) -> dict:
    """Figures of a store whose row groups hold at most ``points`` points."""
    store, each = RunStore(spark, f"{root.rstrip('/')}/bench-{uuid.uuid4().hex}", min_runs=2, block_points=points), -(-rows // runs)
    load, _ = _timed(lambda: [store.append(data.filter(F.col("row").between(k * each, (k + 1) * each - 1)).drop("row")) for k in range(runs)])
    size = store_bytes(store)
    ms = [_timed(lambda: store.query_range(*spec).count())[0] * 1e3 for spec in wanted]
    compaction, _ = _timed(store.compact)
    return {
        "block_max_points": points, "ingest_rows_per_sec": rows / load, "narrow_latency_p95_ms": inclusive_percentile(ms, 0.95), "bytes_per_point": size / max(1, store.stats["flush_points"]),
        "compaction_duration_ms": compaction * 1e3, "compaction_rewrite_bytes": store.stats["compaction_bytes"],
    }


def sweep(spark: SparkSession, root: str, data: DataFrame, rows: int, wanted: list[Spec], sizes: Sequence[int]) -> dict:
    """Measures every block size and selects one."""
    if not sizes:
        raise ValueError("no candidates")
    found = [block_candidate(spark, root, data, rows, wanted, n) for n in sizes]
    return {"candidates": found, "selected_block_max_points": select_block_size(spark, found)}


def select_block_size(spark: SparkSession, candidates: list[dict]) -> int:
    """Of the candidates with at least 90 % of the best ingest rate, the least by narrow p95, bytes a point, compaction time and rewritten bytes."""
    if not candidates:
        raise ValueError("no candidates")
    c = spark.createDataFrame(candidates)
    best = c.agg(F.max("ingest_rows_per_sec").alias("best"))  # one row
    fast = c.crossJoin(F.broadcast(best)).filter(F.col("ingest_rows_per_sec") >= F.col("best") * 0.9)
    order = ["narrow_latency_p95_ms", "bytes_per_point", "compaction_duration_ms", "compaction_rewrite_bytes", "block_max_points"]
    return fast.orderBy(*order).limit(1).first()["block_max_points"]


def summary(figures: object) -> list[str]:
    """Lines that tell a suite's, a scale's or a capture's figures."""
    if isinstance(figures, list):
        return [f"pool {r['pool']}: ingest {r['ingest_only']['points_per_sec']:.1f} points/s at {r['ingest_only']['bytes_per_point']:.3f} bytes a point, wide query p95 {r['wide_query']['latency_p95_ms']:.3f} ms" for r in figures]
    if "frames" in figures:
        return [
            f"{figures['frames']} frames: {figures['points_per_sec']:.1f} points/s, {figures['frames_per_sec']:.1f} frames/s, loss {100 * figures['loss_rate']:.6f} %",
            "batches: " + ", ".join(f"p{p} {figures[f'latency_p{p}_ms']:.3f} ms" for p in (50, 95, 99)),
        ]
    out = [f"{figures['rows']} rows, {figures['total_points']} points, seed {figures['seed']}"]
    for name, found in figures.items():
        if isinstance(found, dict) and name != "sweep":
            out.append(f"{name}: " + ", ".join(f"{k} {v:.3f}" if isinstance(v, float) else f"{k} {v}" for k, v in found.items()))
    if "sweep" in figures:
        out.append(f"sweep: {figures['sweep']['selected_block_max_points']} points a block")
    return out


def report(figures: object, path: str | Path = "") -> str:
    """Indented ASCII JSON, written to ``path`` if there is one."""
    text = json.dumps(figures, indent=2, ensure_ascii=True)
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text + "\n", encoding="ascii")
    return text
