"""The library's queries over the test tables, each with SQL for an independent engine.

``events`` serves as telemetry: an event's type is its parameter and its time, cut to the
hour where a query needs points of one key, its timestamp.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlake import benchmark
from flightlake.functions import scalars as S
from flightlake.operators import points as P
from flightlake.operators import sequences as Q
from flightlake.plans import plot
from flightlake.plans.store import RunStore
from flightlake.schemas import LAYOUT_ENTRY
from flightlake.sources import layout, takeoff
from flightlake.streaming import ingest

START, END = 1704240000000000000, 1705104000000000000  # 2024-01-03 to 2024-01-13
HOUR = 3_600_000_000_000
FOLD_ROWS, FOLD_POINTS = 7, 30
AGE_ROWS, AGE_POINTS, AGE_MS = 50, 120, 3 * 3_600_000
FLUSH_ROWS, FLUSH_POINTS, FLUSH_BYTES = 40, 100, 2_000
TYPES = ["click", "error", "purchase", "signup", "view"]
NAMES = {"click": "IAS", "error": "TAS", "purchase": "BaroAltitude", "signup": "VerticalSpeed", "view": "Engine1_N1"}
Query = Callable[[SparkSession, str], DataFrame]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _ns() -> Column:
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) * 1000")


def _type_id() -> Column:
    out = F.lit(None).cast("long")
    for i, t in enumerate(TYPES, 1):
        out = F.when(F.col("event_type") == t, F.lit(i).cast("long")).otherwise(out)
    return out


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per event; keys are unique."""
    return _events(spark, sf_dir).select(_ns().alias("timestamp_ns"), _type_id().alias("parameter_id"), "value")


def versioned(spark: SparkSession, sf_dir: str, runs: int = 4) -> DataFrame:
    """Points on the hour with many repeats of a key, dealt over runs."""
    e = _events(spark, sf_dir)
    return e.select(F.expr(f"({_NS_SQL}) div {HOUR} * {HOUR}").alias("timestamp_ns"), _type_id().alias("parameter_id"), "value", (F.col("event_id") % runs + 1).alias("run_id"), F.col("event_id").alias("ordinal"))


_NS_SQL = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) * 1000"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.lit(None).cast("string")
    for t, n in NAMES.items():
        names = F.when(F.col("event_type") == t, F.lit(n)).otherwise(names)
    return _events(spark, sf_dir).select(_ns().alias("timestamp_ns"), names.alias("name"), "value")


def _parameters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, NAMES[t], "u") for i, t in enumerate(TYPES, 1)], "parameter_id long, name string, unit string")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as frames: a line's number is the id and its quantity the value, some of them spoilt."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    spoilt = F.when(F.col("l_linenumber") == 3, F.lit("oops")).otherwise(F.col("l_linenumber").cast("string"))
    entry = F.struct(F.concat_ws("_", "l_linenumber", "l_quantity").alias("k"), F.struct(spoilt.alias("parameter_id"), F.col("l_quantity").cast("string").alias("value")).alias("v"))
    return line.groupBy("l_orderkey").agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("values")).select(F.col("l_orderkey").cast("string").alias("seq"), (F.col("l_orderkey") / 8.0).alias("ts_monotonic"), "values")


_LAYOUT = [("IAS", 1, [1, 2, 3, 4], "float"), ("TAS", 2, [1, 3], "float"), ("Gear", 3, [4], "discrete"), ("Flaps", 4, [1, 1, 4, 4], "int")]


def _layout(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1.0, 4, n, i, m, t) for n, i, m, t in _LAYOUT], "major_frame_sec double, minor_frame_count int, name string, parameter_id long, minor_frames array<int>, type string")


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return Q.assign_blocks(versioned(s, d), 64).groupBy("run_id", "block_id").agg(F.sum("n_points").alias("points"), F.min("timestamp_ns").alias("min_ts"), F.max("timestamp_ns").alias("max_ts"))


def _tick_map(s: SparkSession, d: str) -> DataFrame:
    return _layout(s).select("parameter_id", F.explode(layout.ticks(F.col("minor_frames"), F.col("minor_frame_count"), 8)).alias("tick")).withColumn("tick", F.col("tick").cast("long"))


def _schedule(s: SparkSession, d: str) -> DataFrame:
    return layout.generate_frames(s, _layout(s), 4000, 8).groupBy("major_frame", "tick").agg(F.count(F.lit(1)).alias("n"), F.min("parameter_id").alias("first_id"), F.min("seq").alias("seq")).withColumn("tick", F.col("tick").cast("long"))


def _overflow(policy: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        e = _events(s, d).select("event_id", F.expr(f"({_NS_SQL}) div {HOUR}").alias("interval"))
        return Q.overflow(e, "interval", "event_id", 5, policy)

    return run


def _order_sizes(s: SparkSession, d: str) -> DataFrame:
    """Orders as the rows of 64 streams; an order's lines are its points."""
    return s.read.parquet(f"{d}/lineitem.parquet").groupBy((F.col("l_orderkey") % 64).alias("source"), "l_orderkey").agg(F.count(F.lit(1)).alias("n"))


def _fold_batches(s: SparkSession, d: str) -> DataFrame:
    out = Q.ingest_batches(_order_sizes(s, d), "source", "l_orderkey", "n", FOLD_ROWS, FOLD_POINTS)
    return out.groupBy("source", "batch_id").agg(F.count(F.lit(1)).alias("rows"))


def _age_batches(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).select((F.col("event_id") % 4).alias("source"), "event_id", (F.col("event_id") % 5).alias("points"), F.expr(f"({_NS_SQL}) div 1000000").alias("ms"))
    return Q.ingest_batches(e, "source", "event_id", "points", AGE_ROWS, AGE_POINTS, "ms", AGE_MS)


def _flushes(s: SparkSession, d: str) -> DataFrame:
    calls = _order_sizes(s, d).select("source", "l_orderkey", (F.col("n") % 3).alias("rows"), F.col("n").alias("points"))
    return Q.flush_groups(calls, "source", "l_orderkey", "rows", "points", FLUSH_ROWS, FLUSH_POINTS, FLUSH_BYTES)


def _bench_windows(widths: list[int], ids: list[list[int]]) -> list[tuple[int, int, list[int]]]:
    return [(START + k * 7 * HOUR, START + (k * 7 + w) * HOUR, i) for k, (w, i) in enumerate((w, i) for w in widths for i in ids)]


_NARROW = _bench_windows([8, 12, 16, 24], [[1], [1, 2], [1, 2, 3]])
_WIDE = _bench_windows([96, 144, 192, 240], [[1, 2, 3, 4, 5], [1, 2, 3]])


def _bench(specs: list) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        """All windows over one scan and one merge; the windows are a dozen rows."""
        windows = s.createDataFrame([(k, a, b, ids) for k, (a, b, ids) in enumerate(specs)], "query long, a long, b long, ids array<long>")
        points = P.query_range(versioned(s, d), min(a for a, _, _ in specs), max(b for _, b, _ in specs), {i for _, _, ids in specs for i in ids})
        inside = (F.col("timestamp_ns") >= F.col("a")) & (F.col("timestamp_ns") < F.col("b")) & F.array_contains("ids", F.col("parameter_id"))
        found = points.join(F.broadcast(windows), inside).groupBy("query").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("value"), 4).alias("total"))
        return windows.select("query").join(found, "query", "left").select("query", F.coalesce("points", F.lit(0).cast("long")).alias("points"), "total")

    return run


def _home(s: SparkSession) -> str:
    """A new folder that driver and executors share."""
    found = s.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not s.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="flightlake-")
    return f"{found.rstrip('/')}/store-{uuid.uuid4().hex}"


def stored(s: SparkSession, d: str, runs: int = 4, block_points: int | None = None) -> RunStore:
    """A store with one append for each run of ``versioned``."""
    store, rows = RunStore(s, _home(s), min_runs=2, block_points=block_points), versioned(s, d, runs)
    for k in range(1, runs + 1):
        store.append(rows.filter(F.col("run_id") == k).drop("run_id"))
    return store


def _store_compact(s: SparkSession, d: str) -> DataFrame:
    store = stored(s, d)
    store.compact()
    store.vacuum(retention_s=0)
    return store.query_range(0, 1 << 62)


def _store_recover(s: SparkSession, d: str) -> DataFrame:
    """A store with an attempt that never was committed and a newest manifest that is broken, and a run appended after recovery."""
    store = stored(s, d, 3)
    store._write_run(4, versioned(s, d).withColumn("value", F.lit(-1.0)))
    store._publish(f"manifest/v{store.manifest()['version'] + 1}.json", "{broken")
    store.recover()
    store.append(versioned(s, d, 3).filter("run_id = 1").drop("run_id"))
    return store.query_range(START, END)


def _store_catalog(s: SparkSession, d: str) -> DataFrame:
    columns = ["run_id", "point_count", "rows_count", "min_timestamp_ns", "max_timestamp_ns", "min_parameter_id", "max_parameter_id"]
    return s.createDataFrame([[r[c] for c in columns] for r in stored(s, d).manifest()["runs"]], ", ".join(f"{c} long" for c in columns))


def _store_blocks(s: SparkSession, d: str) -> DataFrame:
    """Blocks of the runs, from footers; none has more points than asked for."""
    found = stored(s, d, block_points=100).blocks()
    return found.groupBy("run_id").agg(F.sum("point_count").alias("points"), F.min("min_timestamp_ns").alias("min_ts"), F.max("max_timestamp_ns").alias("max_ts"), (F.max("point_count") <= 100).alias("bounded"))


def _event_frames(s: SparkSession, d: str) -> DataFrame:
    """A frame for each event, in the order of event ids; every thirteenth has no valid entry, every seventeenth none at all; numbers are spoilt as in ``_gap_frames``."""
    e = _events(s, d)
    entry = F.struct(F.when(F.col("event_id") % 13 == 0, F.lit("oops")).otherwise(_type_id().cast("string")).alias("parameter_id"), F.col("value").cast("string").alias("value"))
    values = F.when(F.col("event_id") % 17 == 0, F.create_map().cast("map<string, struct<parameter_id: string, value: string>>")).otherwise(F.create_map(F.col("event_type"), entry))
    seconds = (F.expr(f"({_NS_SQL}) div {HOUR}") * 3600).cast("double")
    number = F.when(F.col("event_id") % 11 == 0, F.lit("oops")).otherwise((F.col("event_id") - F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)).cast("string"))
    return e.select(number.alias("seq"), seconds.alias("ts_monotonic"), values.alias("values"), F.col("ts").alias("arrival_time"), F.lit("").alias("arrival_file"), F.col("event_id").alias("arrival_block"))


def _ingested(s: SparkSession, d: str) -> DataFrame:
    store = RunStore(s, _home(s))
    ingest.commit_batch(store, _event_frames(s, d), 0)
    return store.query_range(0, 1 << 62)


def _ingest_counters(s: SparkSession, d: str) -> DataFrame:
    found = ingest.commit_batch(None, _event_frames(s, d), 0)
    names = ["frames_in", "rows_out", "points_out", "dropped_frames", "seq_gaps"]
    return s.createDataFrame([[int(found[n]) for n in names]], ", ".join(f"{n} long" for n in names))


#: The ten plotted parameters, by the last digit of an event's id.
_TEN = plot.ALTITUDES + [n for b in plot.BANDS for n in b[5]]


def _ten(s: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _TEN)), (F.col("event_id") % 10 + 1).cast("int"))
    return _events(s, d).select(_ns().alias("timestamp_ns"), name.alias("name"), "value")


def _radio(s: SparkSession, d: str) -> DataFrame:
    """No barometric altitude: the radio's is the reference."""
    return plot.altitude_reference(_named(s, d).withColumn("name", F.when(F.col("name") == "BaroAltitude", "RadioAltitude").otherwise(F.col("name"))), 500_000.0)


def _negative(s: SparkSession, d: str) -> DataFrame:
    """Altitudes that end below zero: the greatest of all is the reference."""
    return plot.altitude_reference(_named(s, d).withColumn("value", F.when(F.col("timestamp_ns") % 2000 == 0, F.col("value")).otherwise(-F.col("value"))), 500_000.0)


def _read_layout(s: SparkSession, d: str) -> DataFrame:
    entries = [dict(zip(LAYOUT_ENTRY, (n, "", i, "u", 1, m, 8, t))) for n, i, m, t in _LAYOUT]
    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:  # the driver alone reads it
        json.dump({"major_frame_sec": 1, "minor_frames": 4, "description": "x", "layout": entries}, f)
        f.flush()
        return layout.read_layout(s, f.name).select("name", "parameter_id", F.concat_ws(",", F.transform("minor_frames", lambda x: x.cast("string"))).alias("minor"), "type", "major_frame_sec", F.col("minor_frame_count").cast("long").alias("minor_frame_count"))


def _whole_frames(s: SparkSession, d: str) -> DataFrame:
    """Frames, empty ones too."""
    return layout.whole_frames(s, _layout(s), 4000, 8).select("seq", "major_frame", F.col("tick").cast("long").alias("tick"), F.size("values").cast("long").alias("n"))


_CANDIDATES = [(128, 100.0, 5.0, 9.0), (256, 95.0, 3.0, 9.0), (512, 91.0, 3.0, 8.0), (1024, 80.0, 1.0, 7.0)]


def _sweep(s: SparkSession, d: str) -> DataFrame:
    names = ("block_max_points", "ingest_rows_per_sec", "narrow_latency_p95_ms", "bytes_per_point")
    chosen = benchmark.select_block_size(s, [dict(zip(names, c)) | {"compaction_duration_ms": 1.0, "compaction_rewrite_bytes": 1} for c in _CANDIDATES])
    return s.createDataFrame([(chosen,)], "selected long")


def _nan(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d).withColumn("value", F.when((F.col("parameter_id") == 1) & (F.col("timestamp_ns") % 7 == 0) | (F.col("parameter_id") == 2) & (F.col("timestamp_ns") % 5 == 0), F.lit(float("nan"))).otherwise(F.col("value")))
    return P.aggregate_points(p, START, END).select("parameter_id", "count", F.isnan("min").alias("min_nan"), F.isnan("max").alias("max_nan"), F.isnan("avg").alias("avg_nan"))


def _profile(s: SparkSession, d: str) -> DataFrame:
    return s.range(600).select((F.col("id") / 10.0).alias("t")).withColumn("y", F.round(S.piecewise(F.col("t"), [(0, 10, 0, 100), (10, 30, 100, 100), (30, 50, 100, -20)]), 6))


def _altitude(s: SparkSession, d: str) -> DataFrame:
    return plot.altitude_reference(_named(s, d), 500_000.0)


def _gaps(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).select("event_id", (F.col("event_id") % 8).alias("source"), F.when(F.col("event_id") % 11 == 0, F.lit("oops")).otherwise((F.col("event_id") - F.col("event_id") % 3).cast("string")).alias("seq"))
    return Q.sequence_gaps(e, "source", "event_id")


def _gap_frames(s: SparkSession, d: str) -> DataFrame:
    """All events; one number in eleven is spoilt and one in seven repeats."""
    number = F.col("event_id") - F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    return _events(s, d).select(F.when(F.col("event_id") % 11 == 0, F.lit("oops")).otherwise(number.cast("string")).alias("seq"))


def _deltas(s: SparkSession, d: str) -> DataFrame:
    return Q.timestamp_deltas(points(s, d).drop("value"), "parameter_id")


def _pruning(s: SparkSession, d: str) -> DataFrame:
    hourly = versioned(s, d).withColumn("run_id", F.expr(f"(timestamp_ns - {START}) div {24 * HOUR}"))
    c = P.run_catalog(hourly)
    return c.select("run_id", P.may_hold(START, START + 5 * 24 * HOUR, [2, 9]).alias("opened"), "point_count")


QUERIES: dict[str, Query] = {
    "query_range_all": lambda s, d: P.query_range(versioned(s, d), START, END),
    "query_range_ids": lambda s, d: P.query_range(versioned(s, d), START, END, [1, 3]),
    "query_range_empty_ids": lambda s, d: P.query_range(versioned(s, d), START, END, []),
    "query_range_inverted": lambda s, d: P.query_range(versioned(s, d), END, START),
    "newest_wins_runs": lambda s, d: P.newest_wins(versioned(s, d)),
    "newest_wins_within_run": lambda s, d: P.newest_wins(versioned(s, d, runs=1)),
    "aggregate_range_all": lambda s, d: _rounded(P.aggregate_range(versioned(s, d), START, END), "avg"),
    "aggregate_range_ids_fill": lambda s, d: _rounded(P.aggregate_range(versioned(s, d), START, END, [1, 3, 77]), "avg"),
    "aggregate_no_dedup": lambda s, d: _rounded(P.aggregate_points(versioned(s, d), START, END), "avg"),
    "aggregate_nan_first": _nan,
    "compact_runs": lambda s, d: P.newest_wins(versioned(s, d, runs=16)),
    "compaction_rows_count": lambda s, d: P.newest_wins(versioned(s, d)).agg(F.countDistinct("timestamp_ns").alias("rows_count"), F.count(F.lit(1)).alias("point_count")),
    "run_catalog_stats": lambda s, d: P.run_catalog(versioned(s, d)),
    "run_pruning": _pruning,
    "seq_gaps": _gaps,
    "seq_gaps_in_order": lambda s, d: Q.gaps_in_order(_gap_frames(s, d)),
    "frame_normalize": lambda s, d: P.normalise_frames(_frames(s, d)).select("seq", "timestamp_ns", F.size("columns").cast("long").alias("n")),
    "frame_flatten": lambda s, d: P.flatten_rows(P.normalise_frames(_frames(s, d))),
    "batch_by_rows": lambda s, d: Q.batch_by_rows(_events(s, d).select("event_id", "event_type"), "event_type", "event_id", 100),
    "batch_fold_limits": _fold_batches,
    "batch_fold_age": _age_batches,
    "flush_groups": _flushes,
    "store_query_range": lambda s, d: stored(s, d).query_range(START, END),
    "store_aggregate": lambda s, d: _rounded(stored(s, d).aggregate_range(START, END, [1, 3, 77]), "avg"),
    "store_compact": _store_compact,
    "store_recover": _store_recover,
    "store_catalog": _store_catalog,
    "store_blocks": _store_blocks,
    "ingest_frames": _ingested,
    "ingest_counters": _ingest_counters,
    "overflow_drop_newest": _overflow("drop_newest"),
    "overflow_drop_oldest": _overflow("drop_oldest"),
    "overflow_block": _overflow("block"),
    "block_assign": _blocks,
    "ts_deltas": _deltas,
    "encoded_size": lambda s, d: Q.encoded_size(points(s, d), "parameter_id"),
    "tick_map": _tick_map,
    "fdau_schedule": _schedule,
    "plot_horizon": lambda s, d: plot.horizon(_named(s, d), 86_400.0).select("timestamp_ns", "name", "value", F.round("seconds", 6).alias("seconds")),
    "plot_bands": lambda s, d: plot.band_ranges(plot.horizon(_named(s, d), 864_000.0)),
    "plot_scaled": lambda s, d: _rounded(plot.scaled_series(_named(s, d), 864_000.0), "seconds", "display_y"),
    "plot_ten_series": lambda s, d: _rounded(plot.scaled_series(_ten(s, d), 864_000.0), "seconds", "display_y"),
    "plot_guides": lambda s, d: _rounded(plot.guides(_ten(s, d), 864_000.0), "tick_value", "display_y"),
    "altitude_radio": _radio,
    "altitude_negative": _negative,
    "flt_layout": _read_layout,
    "fdau_frames": _whole_frames,
    "sweep_choice": _sweep,
    "guide_ticks": lambda s, d: _rounded(plot.guide_ticks(plot.band_ranges(_named(s, d))), "tick_value", "display_y"),
    "altitude_asof": _altitude,
    "asof_lookup": lambda s, d: P.as_of(points(s, d), END),
    "smooth_profile": _profile,
    "latency_percentiles": lambda s, d: _events(s, d).groupBy("event_type").agg(*[F.round(S.percentile("value", q), 6).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]),
    "param_dimension_join": lambda s, d: P.with_parameters(points(s, d), _parameters(s)),
    "missing_params": lambda s, d: P.missing_names(_parameters(s), ["IAS", "Mach", "GroundSpeed"]),
    "linear_series": lambda s, d: _rounded(layout.linear_series(s, [(1, 0.0, 300.0), (2, -10.0, 10.0)], 100.0, 4), "value"),
    "takeoff_series": lambda s, d: _rounded(takeoff.takeoff_series(s, {n: i for i, n in enumerate(takeoff.NAMES, 1)}), "value"),
    "bench_narrow": _bench(_NARROW),
    "bench_wide": _bench(_WIDE),
}

# SQL for the same results.
_ID = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES, 1)) + " END::BIGINT"
_NAME = "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{n}'" for t, n in NAMES.items()) + " END"
_PTS = f"p AS (SELECT epoch_us(ts) * 1000 AS timestamp_ns, {_ID} AS parameter_id, value FROM events)"
_NAMED = f"n AS (SELECT epoch_us(ts) * 1000 AS timestamp_ns, {_NAME} AS name, value FROM events)"


def _ver(runs: int = 4) -> str:
    return f"v AS (SELECT (epoch_us(ts) * 1000) // {HOUR} * {HOUR} AS timestamp_ns, {_ID} AS parameter_id, value, event_id % {runs} + 1 AS run_id, event_id AS ordinal FROM events)"


def _won(where: str = "TRUE", runs: int = 4) -> str:
    return f"{_ver(runs)}, w AS (SELECT timestamp_ns, parameter_id, arg_max(value, run_id * 1099511627776 + ordinal) AS value FROM v WHERE {where} GROUP BY ALL)"


_IN = f"timestamp_ns >= {START} AND timestamp_ns < {END}"
_LABELS = f"{START}::BIGINT AS start_ts_ns, {END}::BIGINT AS end_ts_ns"
_AGG = "count(*)::BIGINT AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg"
_BANDS = "b(band, display_min, display_max, fallback_min, fallback_max) AS (VALUES " + ", ".join(f"('{b}', {x}::DOUBLE, {y}::DOUBLE, {u}::DOUBLE, {v}::DOUBLE)" for b, x, y, u, v, _ in plot.BANDS) + ")"
_OF = "o(band, name) AS (VALUES " + ", ".join(f"('{b[0]}', '{n}')" for b in plot.BANDS for n in b[5]) + ")"
_RANGES = """r AS (SELECT band, display_min, display_max, coalesce(lo, fallback_min) AS raw_min, CASE WHEN lo IS NULL THEN fallback_max WHEN hi <= lo THEN lo + 1 ELSE hi END AS raw_max
    FROM b LEFT JOIN (SELECT band, min(value) AS lo, max(value) AS hi FROM {src} JOIN o USING (name) GROUP BY band) USING (band))"""


_TEN_SQL = "n AS (SELECT epoch_us(ts) * 1000 AS timestamp_ns, ([" + ", ".join(f"'{n}'" for n in _TEN) + "])[event_id % 10 + 1] AS name, value FROM events)"
_ALTITUDE = """q AS (SELECT greatest(CASE WHEN coalesce(a, z) > 0 THEN coalesce(a, z) ELSE m END, 1.0) AS reference FROM (
    SELECT arg_max(value, timestamp_ns) FILTER (WHERE name = 'BaroAltitude') AS a, arg_max(value, timestamp_ns) FILTER (WHERE name = 'RadioAltitude') AS z,
    coalesce(max(value) FILTER (WHERE name IN ('BaroAltitude', 'RadioAltitude')), 1.0) AS m FROM h))"""


def _scaled_sql(shown: str) -> str:
    return f"""WITH {shown}, {_BANDS}, {_OF}, {_RANGES.format(src='h')}, {_ALTITUDE}
        SELECT band, name, round(seconds, 6) AS seconds, value, round(display_min + (display_max - display_min) * least(greatest((value - raw_min) / (raw_max - raw_min), 0), 1), 6) AS display_y FROM h JOIN o USING (name) JOIN r USING (band)
        UNION ALL SELECT 'altitude', name, round(seconds, 6), value, round(10000 * least(greatest(value / reference, 0), 1), 6) FROM h, q WHERE name IN ('BaroAltitude', 'RadioAltitude')"""


def _shown(seconds: float, named: str = _NAMED) -> str:
    return f"{named}, h AS (SELECT *, (timestamp_ns - (SELECT min(timestamp_ns) FROM n)) / 1e9 AS seconds FROM n WHERE (timestamp_ns - (SELECT min(timestamp_ns) FROM n)) / 1e9 <= {seconds})"


def _bench_sql(specs: list) -> str:
    parts = [f"SELECT {k}::BIGINT AS query, count(*)::BIGINT AS points, round(sum(value), 4) AS total FROM w WHERE timestamp_ns >= {a} AND timestamp_ns < {b} AND parameter_id IN ({', '.join(map(str, ids))})" for k, (a, b, ids) in enumerate(specs)]
    return f"WITH {_won()} " + " UNION ALL ".join(parts)


def _eased_sql(t0: float, t1: float, v0: float, v1: float) -> str:
    r = f"least(greatest((t - {t0}) / {t1 - t0}, 0), 1)"
    return f"({v0}::DOUBLE + {v1 - v0}::DOUBLE * {r} * {r} * (3 - 2 * {r}))"


def _profile_sql(segments: list) -> str:
    return "CASE " + " ".join(f"WHEN t <= {s[1]} THEN {_eased_sql(*s)}" for s in segments) + f" ELSE {segments[-1][3]} END"


def _takeoff_sql() -> str:
    """The takeoff at 4 Hz over 120 s."""
    speed, baro = f"({_eased_sql(0, 60, 0, 165)} + {_eased_sql(60, 120, 0, 20)})", _profile_sql(takeoff.ALTITUDE)
    of = {
        "BaroAltitude": baro, "RadioAltitude": f"greatest(({baro}) - 120, 0)", "IAS": speed, "TAS": f"{speed} + {_eased_sql(20, 120, 8, 32)}",
        "GroundSpeed": f"greatest({speed} - {_eased_sql(0, 30, 20, 5)}, 0)", "VerticalSpeed": _profile_sql(takeoff.CLIMB), "PitchAngle": _profile_sql(takeoff.PITCH),
        "RollAngle": _profile_sql(takeoff.ROLL), "YawAngle": _profile_sql(takeoff.YAW), "Engine1_N1": _profile_sql(takeoff.N1),
    }
    bound = lambda x, none: f"{none if x is None else x}::DOUBLE"
    rows = " UNION ALL ".join(
        f"SELECT i, t, '{n}' AS name, {k}::BIGINT AS parameter_id, ({of[n]})::DOUBLE AS v, {a}::DOUBLE AS amp, {bound(lo, '-1e300')} AS lo, {bound(hi, '1e300')} AS hi FROM c"
        for k, (n, (a, lo, hi)) in enumerate(takeoff.JITTER.items(), 1)
    )
    of_series = " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(takeoff.NAMES))
    return f"""WITH c AS (SELECT i, i / 4.0::DOUBLE AS t FROM range(481) r(i)), p AS ({rows}),
        x AS (SELECT p.*, k, (CASE name {of_series} END * 99991 + k * 7368787 + 1234577) % 2147483647 AS x, (CASE name {of_series} END * 99991 + (k + 1) * 7368787 + 1234577) % 2147483647 AS y FROM (SELECT *, floor(t / 6)::BIGINT AS k FROM p) p),
        a AS (SELECT *, (x * x % 2147483647 * 48271 % 2147483647) * (2.0::DOUBLE / 2147483647) - 1 AS here, (y * y % 2147483647 * 48271 % 2147483647) * (2.0::DOUBLE / 2147483647) - 1 AS there FROM x),
        j AS (SELECT a.*, here + (there - here) * ((t / 6 - k) * (t / 6 - k) * (3 - 2 * (t / 6 - k))) AS noise,
              CASE WHEN t <= 28 THEN 0 ELSE greatest(least((t - 28) / 8, (120 - t) / 8, 1), 0) END AS taper FROM a)
        SELECT (i * 250000000)::BIGINT AS timestamp_ns, parameter_id, round(least(greatest(v + noise * taper * amp, lo), hi), 6) AS value FROM j"""


_FRAME_SQL = "f AS (SELECT DISTINCT l_orderkey, trunc(l_orderkey / 8.0 * 1e9)::BIGINT AS timestamp_ns, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber <> 3)"
_DELTA = f"{_PTS}, x AS (SELECT timestamp_ns, parameter_id, timestamp_ns - lag(timestamp_ns, 1, timestamp_ns) OVER (PARTITION BY parameter_id ORDER BY timestamp_ns) AS delta_ns FROM p)"
_LAYOUT_SQL = "l(parameter_id, m) AS (VALUES " + ", ".join(f"({i}::BIGINT, {m}::INT)" for _, i, ms, _ in _LAYOUT for m in ms) + "), t AS (SELECT DISTINCT parameter_id, least(7, floor((m - 0.5) / 4 * 8))::BIGINT AS tick FROM l)"

ORACLE: dict[str, str] = {
    "query_range_all": f"WITH {_won(_IN)} SELECT * FROM w",
    "query_range_ids": f"WITH {_won(_IN + ' AND parameter_id IN (1, 3)')} SELECT * FROM w",
    "query_range_empty_ids": f"WITH {_won('FALSE')} SELECT * FROM w",
    "query_range_inverted": f"WITH {_won(f'timestamp_ns >= {END} AND timestamp_ns < {START}')} SELECT * FROM w",
    "newest_wins_runs": f"WITH {_won()} SELECT * FROM w",
    "newest_wins_within_run": f"WITH {_won(runs=1)} SELECT * FROM w",
    "aggregate_range_all": f"WITH {_won(_IN)} SELECT {_LABELS}, parameter_id, {_AGG} FROM w GROUP BY parameter_id",
    "aggregate_range_ids_fill": f"WITH {_won(_IN)} SELECT {_LABELS}, i.parameter_id, count(w.value)::BIGINT AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg FROM (VALUES (1::BIGINT), (3), (77)) i(parameter_id) LEFT JOIN w USING (parameter_id) GROUP BY i.parameter_id",
    "aggregate_no_dedup": f"WITH {_ver()} SELECT {_LABELS}, parameter_id, {_AGG} FROM v GROUP BY parameter_id",
    "aggregate_nan_first": f"""WITH {_PTS}, q AS (SELECT timestamp_ns, parameter_id, CASE WHEN (parameter_id = 1 AND timestamp_ns % 7 = 0) OR (parameter_id = 2 AND timestamp_ns % 5 = 0) THEN 'nan'::DOUBLE ELSE value END AS value FROM p)
        SELECT parameter_id, count(*)::BIGINT AS count, isnan(arg_min(value, timestamp_ns)) AS min_nan, isnan(arg_min(value, timestamp_ns)) AS max_nan, bool_or(isnan(value)) AS avg_nan FROM q GROUP BY parameter_id""",
    "compact_runs": f"WITH {_won(runs=16)} SELECT * FROM w",
    "compaction_rows_count": f"WITH {_won()} SELECT count(DISTINCT timestamp_ns)::BIGINT AS rows_count, count(*)::BIGINT AS point_count FROM w",
    "run_catalog_stats": f"WITH {_ver()} SELECT run_id, count(*)::BIGINT AS point_count, min(timestamp_ns) AS min_timestamp_ns, max(timestamp_ns) AS max_timestamp_ns, min(parameter_id) AS min_parameter_id, max(parameter_id) AS max_parameter_id FROM v GROUP BY run_id",
    "run_pruning": f"""WITH {_ver()}, c AS (SELECT trunc((timestamp_ns - {START}) / {24 * HOUR})::BIGINT AS run_id, count(*)::BIGINT AS point_count, min(timestamp_ns) AS a, max(timestamp_ns) AS z, min(parameter_id) AS i, max(parameter_id) AS j FROM v GROUP BY 1)
        SELECT run_id, z >= {START} AND a < {START + 5 * 24 * HOUR} AND ((i <= 2 AND j >= 2) OR (i <= 9 AND j >= 9)) AS opened, point_count FROM c""",
    "seq_gaps": """WITH s AS (SELECT event_id % 8 AS source, event_id, event_id - event_id % 3 AS seq FROM events WHERE event_id % 11 <> 0),
        g AS (SELECT *, seq <> lag(seq) OVER (PARTITION BY source ORDER BY event_id) + 1 AS gap FROM s)
        SELECT source, (count(*) FILTER (WHERE gap))::BIGINT AS seq_gaps, arg_max(seq, event_id) AS last_seq FROM g GROUP BY source""",
    "seq_gaps_in_order": """WITH s AS (SELECT event_id - CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS seq FROM events WHERE event_id % 11 <> 0),
        g AS (SELECT seq, seq <> lag(seq) OVER (ORDER BY seq) + 1 AS gap FROM s)
        SELECT (count(*) FILTER (WHERE gap))::BIGINT AS seq_gaps, min(seq)::BIGINT AS first_seq, max(seq)::BIGINT AS last_seq FROM g""",
    "frame_normalize": f"WITH {_FRAME_SQL} SELECT l_orderkey::VARCHAR AS seq, timestamp_ns, count(*)::BIGINT AS n FROM f GROUP BY ALL",
    "frame_flatten": f"WITH {_FRAME_SQL} SELECT l_orderkey::VARCHAR AS seq, l_orderkey / 8.0::DOUBLE AS ts_monotonic, timestamp_ns, l_linenumber::BIGINT AS parameter_id, l_quantity::DOUBLE AS value FROM f",
    "batch_by_rows": "SELECT event_id, event_type, ((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100)::BIGINT AS batch_id FROM events",
    "batch_fold_limits": f"""WITH RECURSIVE o AS (SELECT l_orderkey % 64 AS source, l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT source, n, row_number() OVER (PARTITION BY source ORDER BY l_orderkey) AS k FROM o),
        f AS (SELECT source, k, 0 AS batch_id, 1 AS r, n AS p FROM t WHERE k = 1
              UNION ALL SELECT t.source, t.k, CASE WHEN f.r >= {FOLD_ROWS} OR f.p >= {FOLD_POINTS} THEN f.batch_id + 1 ELSE f.batch_id END,
                  CASE WHEN f.r >= {FOLD_ROWS} OR f.p >= {FOLD_POINTS} THEN 1 ELSE f.r + 1 END, CASE WHEN f.r >= {FOLD_ROWS} OR f.p >= {FOLD_POINTS} THEN t.n ELSE f.p + t.n END
              FROM f JOIN t ON t.source = f.source AND t.k = f.k + 1)
        SELECT source, batch_id::BIGINT AS batch_id, count(*)::BIGINT AS rows FROM f GROUP BY ALL""",
    "batch_fold_age": f"""WITH RECURSIVE e AS (SELECT event_id % 4 AS source, event_id, event_id % 5 AS points, epoch_us(ts) // 1000 AS ms FROM events), t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY event_id) AS k FROM e),
        f AS (SELECT source, event_id, points, k, 0 AS batch_id, 1 AS r, points AS p, ms AS began FROM t WHERE k = 1
              UNION ALL SELECT t.source, t.event_id, t.points, t.k, CASE WHEN f.r >= {AGE_ROWS} OR f.p >= {AGE_POINTS} OR t.ms - f.began >= {AGE_MS} THEN f.batch_id + 1 ELSE f.batch_id END,
                  CASE WHEN f.r >= {AGE_ROWS} OR f.p >= {AGE_POINTS} OR t.ms - f.began >= {AGE_MS} THEN 1 ELSE f.r + 1 END, CASE WHEN f.r >= {AGE_ROWS} OR f.p >= {AGE_POINTS} OR t.ms - f.began >= {AGE_MS} THEN t.points ELSE f.p + t.points END,
                  CASE WHEN f.r >= {AGE_ROWS} OR f.p >= {AGE_POINTS} OR t.ms - f.began >= {AGE_MS} THEN t.ms ELSE f.began END
              FROM f JOIN t ON t.source = f.source AND t.k = f.k + 1)
        SELECT source, event_id, points, batch_id::BIGINT AS batch_id FROM f""",
    "flush_groups": f"""WITH RECURSIVE o AS (SELECT l_orderkey % 64 AS source, l_orderkey, count(*) AS points, count(*) % 3 AS rows FROM lineitem GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY l_orderkey) AS k FROM o),
        f AS (SELECT source, l_orderkey, points, k, 0 AS flush_id, rows AS r, points AS p FROM t WHERE k = 1
              UNION ALL SELECT t.source, t.l_orderkey, t.points, t.k, CASE WHEN f.r >= {FLUSH_ROWS} OR f.p >= {FLUSH_POINTS} OR f.p * 24 >= {FLUSH_BYTES} THEN f.flush_id + 1 ELSE f.flush_id END,
                  CASE WHEN f.r >= {FLUSH_ROWS} OR f.p >= {FLUSH_POINTS} OR f.p * 24 >= {FLUSH_BYTES} THEN t.rows ELSE f.r + t.rows END, CASE WHEN f.r >= {FLUSH_ROWS} OR f.p >= {FLUSH_POINTS} OR f.p * 24 >= {FLUSH_BYTES} THEN t.points ELSE f.p + t.points END
              FROM f JOIN t ON t.source = f.source AND t.k = f.k + 1)
        SELECT source, l_orderkey, points::BIGINT AS points, flush_id::BIGINT AS flush_id FROM f""",
    "store_query_range": f"WITH {_won(_IN)} SELECT * FROM w",
    "store_aggregate": f"WITH {_won(_IN)} SELECT {_LABELS}, i.parameter_id, count(w.value)::BIGINT AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg FROM (VALUES (1::BIGINT), (3), (77)) i(parameter_id) LEFT JOIN w USING (parameter_id) GROUP BY i.parameter_id",
    "store_compact": f"WITH {_won()} SELECT * FROM w",
    "store_recover": f"WITH {_ver(3)}, w AS (SELECT timestamp_ns, parameter_id, arg_max(value, CASE run_id WHEN 1 THEN 4 ELSE run_id END * 1099511627776 + ordinal) AS value FROM v WHERE {_IN} GROUP BY ALL) SELECT * FROM w",
    "store_catalog": f"WITH {_ver()} SELECT run_id, count(*)::BIGINT AS point_count, count(DISTINCT timestamp_ns)::BIGINT AS rows_count, min(timestamp_ns) AS min_timestamp_ns, max(timestamp_ns) AS max_timestamp_ns, min(parameter_id) AS min_parameter_id, max(parameter_id) AS max_parameter_id FROM v GROUP BY run_id",
    "store_blocks": f"WITH {_ver()} SELECT run_id, count(*)::BIGINT AS points, min(timestamp_ns) AS min_ts, max(timestamp_ns) AS max_ts, TRUE AS bounded FROM v GROUP BY run_id",
    "ingest_frames": f"WITH {_ver(1)} SELECT timestamp_ns, parameter_id, arg_max(value, ordinal) AS value FROM v WHERE ordinal % 13 <> 0 AND ordinal % 17 <> 0 GROUP BY ALL",
    "ingest_counters": """SELECT count(*)::BIGINT AS frames_in, (count(*) FILTER (WHERE event_id % 13 <> 0 AND event_id % 17 <> 0))::BIGINT AS rows_out, (count(*) FILTER (WHERE event_id % 13 <> 0 AND event_id % 17 <> 0))::BIGINT AS points_out,
        (count(*) FILTER (WHERE event_id % 13 = 0 AND event_id % 17 <> 0))::BIGINT AS dropped_frames, (SELECT count(*) FILTER (WHERE gap) FROM (SELECT s <> lag(s) OVER (ORDER BY event_id) + 1 AS gap FROM (SELECT event_id, event_id - CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS s FROM events WHERE event_id % 11 <> 0)))::BIGINT AS seq_gaps FROM events""",
    "overflow_drop_newest": f"SELECT event_id, (epoch_us(ts) * 1000) // {HOUR} AS interval FROM events QUALIFY row_number() OVER (PARTITION BY (epoch_us(ts) * 1000) // {HOUR} ORDER BY event_id) <= 5",
    "overflow_drop_oldest": f"SELECT event_id, (epoch_us(ts) * 1000) // {HOUR} AS interval FROM events QUALIFY row_number() OVER (PARTITION BY (epoch_us(ts) * 1000) // {HOUR} ORDER BY event_id DESC) <= 5",
    "overflow_block": f"SELECT event_id, (epoch_us(ts) * 1000) // {HOUR} AS interval FROM events",
    "block_assign": f"""WITH RECURSIVE {_ver()}, c AS (SELECT run_id, timestamp_ns, count(*) AS n FROM v GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY timestamp_ns) AS k FROM c),
        f AS (SELECT run_id, k, timestamp_ns, n, 0 AS block_id, n AS c FROM t WHERE k = 1
              UNION ALL SELECT t.run_id, t.k, t.timestamp_ns, t.n, CASE WHEN f.c >= 64 THEN f.block_id + 1 ELSE f.block_id END, CASE WHEN f.c >= 64 THEN t.n ELSE f.c + t.n END FROM f JOIN t ON t.run_id = f.run_id AND t.k = f.k + 1)
        SELECT run_id, block_id::BIGINT AS block_id, sum(n)::BIGINT AS points, min(timestamp_ns) AS min_ts, max(timestamp_ns) AS max_ts FROM f GROUP BY ALL""",
    "ts_deltas": f"WITH {_DELTA} SELECT * FROM x",
    "encoded_size": f"""WITH {_DELTA}, s AS (SELECT parameter_id, count(*)::BIGINT AS n, sum(greatest(1, ceil(length(bin(delta_ns)) / 7.0)))::BIGINT AS varints FROM x GROUP BY parameter_id)
        SELECT parameter_id, n AS point_count, n * 20 AS raw_bytes, (21 + 4 + varints + n + 8 * n)::BIGINT AS columnar_bytes FROM s""",
    "tick_map": f"WITH {_LAYOUT_SQL} SELECT parameter_id, tick FROM t",
    "fdau_schedule": f"WITH {_LAYOUT_SQL} SELECT s // 8 AS major_frame, t.tick, count(*)::BIGINT AS n, min(parameter_id) AS first_id, min(s)::BIGINT AS seq FROM range(4000) r(s) JOIN t ON t.tick = s % 8 GROUP BY 1, 2",
    "plot_horizon": f"WITH {_shown(86400.0)} SELECT timestamp_ns, name, value, round(seconds, 6) AS seconds FROM h",
    "plot_bands": f"WITH {_shown(864000.0)}, {_BANDS}, {_OF}, {_RANGES.format(src='h')} SELECT * FROM r",
    "plot_scaled": _scaled_sql(_shown(864000.0)),
    "plot_ten_series": _scaled_sql(_shown(864000.0, _TEN_SQL)),
    "plot_guides": f"""WITH {_shown(864000.0, _TEN_SQL)}, {_BANDS}, {_OF}, {_RANGES.format(src='h')}, {_ALTITUDE}, g AS (SELECT band, display_min, display_max, raw_min, raw_max FROM r UNION ALL SELECT 'altitude_detail', 0.0, 1000.0, 0.0, reference * 0.1 FROM q),
        x AS (SELECT band, f::DOUBLE AS fraction, raw_min + (raw_max - raw_min) * f AS tick_value, display_min + (display_max - display_min) * f AS display_y FROM g, (VALUES (0.5::DOUBLE), (0.0)) x(f)),
        l(band, title, series) AS (VALUES ('altitude_detail', 'Altitude', ''), ('speed', 'Speed', 'IAS' || chr(10) || 'TAS' || chr(10) || 'Ground speed'), ('vertical_speed', 'VSpeed', 'Vertical speed'),
            ('attitude', 'Attitude', 'PitchAngle' || chr(10) || 'RollAngle' || chr(10) || 'YawAngle'), ('engine_n1', 'Engine N1', 'Engine1 N1'))
        SELECT band, title, series, fraction, round(tick_value, 6) AS tick_value, CASE WHEN abs(tick_value - round_even(tick_value, 0)) <= greatest(1e-9 * abs(tick_value), 1e-9) THEN round_even(tick_value, 0)::BIGINT::VARCHAR ELSE printf('%.1f', tick_value) END AS label, round(display_y, 6) AS display_y
        FROM x JOIN l USING (band)""",
    "altitude_radio": f"""WITH {_shown(500000.0)} SELECT greatest(CASE WHEN a > 0 THEN a ELSE m END, 1.0) AS reference FROM (
        SELECT arg_max(value, timestamp_ns) FILTER (WHERE name = 'BaroAltitude') AS a, coalesce(max(value) FILTER (WHERE name = 'BaroAltitude'), 1.0) AS m FROM h)""",
    "altitude_negative": f"""WITH {_shown(500000.0)}, s AS (SELECT timestamp_ns, name, CASE WHEN timestamp_ns % 2000 = 0 THEN value ELSE -value END AS value FROM h) SELECT greatest(CASE WHEN a > 0 THEN a ELSE m END, 1.0) AS reference FROM (
        SELECT arg_max(value, timestamp_ns) FILTER (WHERE name = 'BaroAltitude') AS a, coalesce(max(value) FILTER (WHERE name = 'BaroAltitude'), 1.0) AS m FROM s)""",
    "flt_layout": "SELECT name, id::BIGINT AS parameter_id, minor, type, 1.0::DOUBLE AS major_frame_sec, 4::BIGINT AS minor_frame_count FROM (VALUES " + ", ".join(f"('{n}', {i}, '{','.join(map(str, m))}', '{t}')" for n, i, m, t in _LAYOUT) + ") l(name, id, minor, type)",
    "fdau_frames": f"WITH {_LAYOUT_SQL} SELECT s::BIGINT AS seq, (s // 8)::BIGINT AS major_frame, (s % 8)::BIGINT AS tick, (SELECT count(*) FROM t WHERE t.tick = s % 8)::BIGINT AS n FROM range(4000) r(s)",
    "sweep_choice": "WITH c(b, rate, p95, size) AS (VALUES " + ", ".join(f"({b}, {r}, {p}, {z})" for b, r, p, z in _CANDIDATES) + ") SELECT b::BIGINT AS selected FROM c WHERE rate >= 0.9 * (SELECT max(rate) FROM c) ORDER BY p95, size, b LIMIT 1",
    "guide_ticks": f"""WITH {_NAMED}, {_BANDS}, {_OF}, {_RANGES.format(src='n')}
        SELECT band, f::DOUBLE AS fraction, round(raw_min + (raw_max - raw_min) * f, 6) AS tick_value, round(display_min + (display_max - display_min) * f, 6) AS display_y FROM r, (VALUES (0.5), (0.0)) x(f)""",
    "altitude_asof": f"""WITH {_shown(500000.0)} SELECT greatest(CASE WHEN a > 0 THEN a ELSE m END, 1.0) AS reference FROM (
        SELECT arg_max(value, timestamp_ns) FILTER (WHERE name = 'BaroAltitude') AS a, coalesce(max(value) FILTER (WHERE name = 'BaroAltitude'), 1.0) AS m FROM h)""",
    "asof_lookup": f"WITH {_PTS} SELECT parameter_id, arg_max(value, timestamp_ns) AS value, max(timestamp_ns) AS timestamp_ns FROM p WHERE timestamp_ns <= {END} GROUP BY parameter_id",
    "smooth_profile": """SELECT i / 10.0::DOUBLE AS t, round(CASE WHEN i <= 100 THEN 100 * (i / 100.0) * (i / 100.0) * (3 - 2 * (i / 100.0)) WHEN i <= 300 THEN 100
        WHEN i <= 500 THEN 100 - 120 * ((i - 300) / 200.0) * ((i - 300) / 200.0) * (3 - 2 * ((i - 300) / 200.0)) ELSE -20 END::DOUBLE, 6) AS y FROM range(600) r(i)""",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
    "param_dimension_join": f"WITH {_PTS} SELECT parameter_id, timestamp_ns, value, name, 'u' AS unit FROM p JOIN (VALUES " + ", ".join(f"({i}::BIGINT, '{NAMES[t]}')" for i, t in enumerate(TYPES, 1)) + ") d(parameter_id, name) USING (parameter_id)",
    "missing_params": f"SELECT name FROM (VALUES ('IAS'), ('Mach'), ('GroundSpeed')) m(name) WHERE name NOT IN ({', '.join(repr(n) for n in NAMES.values())})",
    "linear_series": "SELECT (s * 250000000)::BIGINT AS timestamp_ns, i::BIGINT AS parameter_id, round(lo + (hi - lo) * (s / 400.0)::DOUBLE, 6) AS value FROM range(401) r(s), (VALUES (1, 0.0::DOUBLE, 300.0::DOUBLE), (2, -10.0, 10.0)) p(i, lo, hi)",
    "takeoff_series": _takeoff_sql(),
    "bench_narrow": _bench_sql(_NARROW),
    "bench_wide": _bench_sql(_WIDE),
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
