"""Order-dependent operators: gaps, batches, overflow policies, blocks, encoded sizes.

Sources and runs are ordered streams as they arrived; a long one is cut into ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightlake.operators.batches import Limits, greedy_groups
from flightlake.operators.ranges import with_previous, with_row_number


def sequence_gaps(frames: DataFrame, by: str, order: str, first: bool = False) -> DataFrame:
    """(by, seq_gaps, last_seq, and first_seq if asked for): every seq that is not the one before plus 1 counts once; a seq that is no integer is skipped."""
    seq = frames.select(by, order, F.col("seq").cast("string").try_cast("long").alias("seq")).filter("seq IS NOT NULL")
    least = F.lit(-(1 << 63))
    follows = (F.col("seq") > least) & (F.col("seq") - F.when(F.col("seq") > least, 1).otherwise(0) == F.col("before"))  # the least BIGINT follows nothing
    gap = F.when(F.col("before").isNotNull(), (~follows).cast("long"))
    met = with_previous(seq, [by], [order], "seq", "before").withColumn("gap", gap)
    more = [F.min_by("seq", order).alias("first_seq")] if first else []
    return met.groupBy(by).agg(F.coalesce(F.sum("gap"), F.lit(0).cast("long")).alias("seq_gaps"), F.max_by("seq", order).alias("last_seq"), *more)


def gaps_in_order(frames: DataFrame) -> DataFrame:
    """One row (seq_gaps, first_seq, last_seq) of frames taken in the order of seq, without a window over all of them.

    In that order a frame follows without a gap only the first time its number does, and
    only if the number before is there; every other frame but the first counts as a gap.
    """
    seq = frames.select(F.col("seq").cast("string").try_cast("long").alias("seq")).filter("seq IS NOT NULL")
    numbers = seq.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    most = (1 << 63) - 1  # nothing follows it; a follower with no rows beside the number itself changes nothing but "after"
    own, follower = F.struct("seq", "n", F.lit(False).alias("after")), F.struct((F.col("seq") + F.when(F.col("seq") < most, 1).otherwise(0)).alias("seq"), F.lit(0).cast("long").alias("n"), (F.col("seq") < most).alias("after"))
    met = numbers.select(F.inline(F.array(own, follower))).groupBy("seq").agg(F.sum("n").alias("n"), F.max("after").alias("after")).filter("n > 0")
    gaps = F.sum("n") - F.count(F.when(F.col("after"), 1)) - 1
    return met.agg(F.greatest(F.coalesce(gaps, F.lit(0)), F.lit(0)).cast("long").alias("seq_gaps"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def batch_by_rows(rows: DataFrame, by: str, order: str, max_rows: int) -> DataFrame:
    """Adds ``batch_id``: every ``max_rows`` rows of a stream close a batch."""
    return with_row_number(rows, [by], [order], "_n").withColumn("batch_id", F.floor((F.col("_n") - 1) / max_rows).cast("long")).drop("_n")


def ingest_batches(rows: DataFrame, by: str, order: str, points: str, max_rows: int, max_points: int, arrived: str | None = None, max_age: int = 0) -> DataFrame:
    """(by, order, points, batch_id): a batch closes at its ``max_rows``-th row, or once its points reach ``max_points``, or by age.

    A row that arrives ``max_age`` or more after the batch's first begins the next one; 0 or less disables a limit.
    """
    return greedy_groups(rows, by, order, points, Limits(max_rows, max_points, max_age), time=arrived)


#: Fixed value: bytes that a buffered point counts.
POINT_BYTES = 24


def flush_groups(appends: DataFrame, by: str, order: str, rows: str, points: str, max_rows: int, max_points: int, max_bytes: int) -> DataFrame:
    """(by, order, points, flush_id): a buffer flushes after the append that fills its rows, points or bytes; 0 or less disables.

    ``appends`` has one row for each call. Bytes are a multiple of points, so both are one limit.
    """
    most = [p for p in (max_points, -(-max_bytes // POINT_BYTES)) if p > 0]
    return greedy_groups(appends, by, order, points, Limits(max_rows, min(most, default=0)), "flush_id", rows)


def overflow(frames: DataFrame, interval: str, order: str, capacity: int, policy: str) -> DataFrame:
    """What a bounded queue keeps of each interval: ``drop_oldest`` the last, ``block`` all, any other policy the first frames."""
    if policy == "block":
        return frames
    by = F.col(order).desc() if policy == "drop_oldest" else F.col(order).asc()
    return frames.withColumn("_place", F.row_number().over(Window.partitionBy(interval).orderBy(by))).filter(F.col("_place") <= capacity).drop("_place")


def assign_blocks(points: DataFrame, max_points: int, by: str = "run_id") -> DataFrame:
    """(by, timestamp_ns, n_points, block_id): greedy blocks that close at the first timestamp with ``max_points`` points or more."""
    per_time = points.groupBy(by, "timestamp_ns").agg(F.count(F.lit(1)).alias("n_points"))
    return greedy_groups(per_time, by, "timestamp_ns", "n_points", Limits(size=max_points), "block_id")


def timestamp_deltas(points: DataFrame, by: str) -> DataFrame:
    """Adds ``delta_ns``: the step from the point before, 0 for the first."""
    met = with_previous(points, [by], ["timestamp_ns", "parameter_id"], "timestamp_ns", "_before")
    return met.withColumn("delta_ns", F.coalesce(F.col("timestamp_ns") - F.col("_before"), F.lit(0).cast("long"))).drop("_before")


def uvarint_length(n: Column) -> Column:
    """Bytes of an unsigned LEB128."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7.0)).cast("long")


def encoded_size(points: DataFrame, by: str) -> DataFrame:
    """(by, point_count, raw_bytes, columnar_bytes) under the row and the columnar block format."""
    stats = timestamp_deltas(points, by).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("parameter_id").alias("ids"), F.sum(uvarint_length(F.col("delta_ns"))).alias("varints")
    )
    width = F.when(F.col("ids") <= 255, 1).when(F.col("ids") <= 65535, 2).otherwise(4)
    return stats.select(by, F.col("n").alias("point_count"), (F.col("n") * 20).alias("raw_bytes"), (F.lit(21) + 4 * F.col("ids") + F.col("varints") + width * F.col("n") + 8 * F.col("n")).cast("long").alias("columnar_bytes"))
