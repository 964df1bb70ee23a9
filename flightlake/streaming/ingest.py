"""Continuous ingest: JSON frames to runs, exactly once per micro-batch.

The store skips a batch id it has committed, so a restart repeats no points. No watermark:
late points are kept, and "newest" means the later arrival. Frames arrive in the order of
their files' times, and of their lines in a file. The manifest carries the last sequence
number, so a gap between batches counts too. Back-pressure is the source's own
(``maxFilesPerTrigger``); a batch is what a trigger brings, and the store's runs are flushed
with it, so nothing is buffered that a crash could lose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flightlake.operators import points as P
from flightlake.operators.sequences import flush_groups, ingest_batches, overflow, sequence_gaps
from flightlake.plans.store import RunStore
from flightlake.schemas import FRAMES

#: What a file source says of a row's place; sources that lack it arrive in the order of their partitions.
ARRIVAL = ["arrival_time", "arrival_file", "arrival_block"]
#: ``monotonically_increasing_id`` counts rows of a partition below this bit, partitions above.
_PARTITION_BIT = 33


def read_frames(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    frames = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files_per_trigger).json(path)
    m = F.col("_metadata")
    return frames.select("*", m["file_modification_time"].alias(ARRIVAL[0]), m["file_path"].alias(ARRIVAL[1]), m["file_block_start"].alias(ARRIVAL[2]))


def numbered(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames with ``arrival``, what to unpersist): numbers from 0 without a hole, in order of arrival.

    Frames are sorted, never gathered; the driver learns how many each partition holds.
    """
    order = [c for c in ARRIVAL if c in batch.columns]
    placed = batch.withColumn("_place", F.monotonically_increasing_id())
    sorted_ = placed.orderBy(*order, "_place") if order else placed
    kept = sorted_.drop("_place", *order).withColumn("_id", F.monotonically_increasing_id()).persist()
    part = F.shiftright("_id", _PARTITION_BIT)
    before, total = {}, 0
    for r in kept.groupBy(part.alias("p")).count().orderBy("p").collect():
        before[r["p"]], total = total, total + r["count"]
    start: Column = F.lit(0)
    if before:
        start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), part)
    return kept.withColumn("arrival", (start + F.col("_id").bitwiseAND((1 << _PARTITION_BIT) - 1)).cast("long")).drop("_id"), kept


def commit_batch(store: RunStore | None, batch: DataFrame, batch_id: int, clock: Column | None = None) -> dict:
    """Commits the points of a batch of frames and returns its counters; without a store it only counts.

    ``dropped_frames`` are those with values that gave no point: no valid entry or no valid time.
    """
    frames, kept = numbered(batch)
    try:
        rows = P.normalise_frames(frames, clock)
        points = P.flatten_rows(rows.select("timestamp_ns", F.col("arrival").alias("ordinal"), "columns"))
        gaps = sequence_gaps(frames.withColumn("_source", F.lit(0)), "_source", "arrival", first=True).first()
        counts = frames.agg(F.count(F.lit(1)).alias("frames"), F.count(F.when(F.size("values") > 0, 1)).alias("filled")).first()
        out = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("columns")), F.lit(0)).alias("points")).first()
        before = store.manifest()["last_seq"] if store is not None else None
        between = gaps is not None and before is not None and gaps["first_seq"] != before + 1
        done = store is not None and store.append(points, batch_id=batch_id, last_seq=None if gaps is None else gaps["last_seq"])
        return {
            "batch_id": batch_id, "committed": done, "frames_in": counts["frames"], "rows_out": out["rows"], "points_out": out["points"],
            "dropped_frames": counts["filled"] - out["rows"], "seq_gaps": (gaps["seq_gaps"] if gaps is not None else 0) + between, "queue_size": 0,
        }
    finally:
        kept.unpersist()


def ingest(frames: DataFrame, store: RunStore | None, checkpoint: str, on_batch: Callable[[dict], object] | None = None, clock: Column | None = None) -> StreamingQuery:
    """Starts the query; ``on_batch`` gets a dict of counters after each commit. ``clock`` (seconds) stands in for missing times."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        found = commit_batch(store, batch, batch_id, clock)
        if on_batch is not None:
            on_batch(found)

    return frames.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(store: RunStore, frames: DataFrame, settings) -> dict:
    """Appends whole frames (seq, ts_monotonic, values as an array) as a bounded queue, batches and flush limits would, and returns counters.

    The queue keeps what ``overflow`` lets it of each second; batches close by rows, points
    and age, flushes after the batch that fills the buffer, and each flush is one run.
    """
    own = frames.select(F.lit(0).alias("source"), "seq", F.floor("ts_monotonic").alias("second"), (F.col("ts_monotonic") * 1000).cast("long").alias("ms"), (F.col("ts_monotonic") * F.lit(1e9)).try_cast("long").alias("timestamp_ns"), "values")
    queue, limits = settings.ingest, settings.storage
    kept = overflow(own, "second", "seq", queue.queue_max_frames, queue.overflow_policy).withColumn("points", F.size(F.filter("values", lambda v: v["value"].isNotNull())))
    filled = kept.filter("points > 0")
    batches = ingest_batches(filled, "source", "seq", "points", queue.batch_max_rows, queue.batch_max_points, "ms", queue.batch_max_ms)
    appends = batches.groupBy("source", "batch_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("points").alias("points"))
    flushes = flush_groups(appends, "source", "batch_id", "rows", "points", limits.flush_max_rows, limits.flush_max_points, limits.flush_max_bytes)
    runs = filled.join(batches.select("seq", "batch_id"), "seq").join(flushes.select("batch_id", "flush_id"), "batch_id").persist()
    try:
        last = runs.agg(F.max("flush_id")).first()[0]
        for k in range(0 if last is None else last + 1):
            points = runs.filter(F.col("flush_id") == k).select("timestamp_ns", F.col("seq").alias("ordinal"), F.inline("values"))
            store.append(points.filter("value IS NOT NULL").select("timestamp_ns", "parameter_id", "value", "ordinal"))
        done = runs.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("points"), F.lit(0)).alias("points")).first()
    finally:
        runs.unpersist()
    gaps = sequence_gaps(kept.select("source", "seq", F.col("seq").alias("at")), "source", "at").first()
    n, queued = frames.count(), kept.count()
    dropped = n - queued if queue.overflow_policy != "drop_oldest" else 0  # what the queue evicts is not counted
    return {"frames_in": queued, "rows_out": done["rows"], "points_out": done["points"], "dropped_frames": dropped, "seq_gaps": gaps["seq_gaps"] if gaps is not None else 0, "queue_size": 0}


class Statistics:
    """Totals over batches, and lines that tell what each second brought."""

    COUNTED = ("frames_in", "rows_out", "points_out", "dropped_frames", "seq_gaps")

    def __init__(self) -> None:
        self.totals = dict.fromkeys((*self.COUNTED, "queue_size"), 0)

    def line(self, found: dict, seconds: float) -> str:
        """Adds a batch that took ``seconds`` and describes totals and rates."""
        parts = []
        for k in self.COUNTED:
            self.totals[k] += found[k]
            rate = found[k] / seconds if seconds > 0 else 0.0
            parts.append(f"{k}={self.totals[k]}" + (f" (+{rate:.1f}/s)" if k != "seq_gaps" else ""))
        self.totals["queue_size"] = found["queue_size"]
        return " ".join([*parts, f"queue_size={found['queue_size']}"])
