"""The parameter layout (JSON) and the tick map of its minor frames."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlake.schemas import LAYOUT_ENTRY, LAYOUT_HEADER


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """One row per parameter with the header's fields; strict keys, ``layout`` must be a list.

    The file is a dimension of some thousand entries at most and is validated on the driver.
    """
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict) or "layout" not in data:
        raise KeyError("layout")
    if not isinstance(data["layout"], list):
        raise TypeError("layout must be a list")
    if set(data) != set(LAYOUT_HEADER):
        raise TypeError(f"keys must be {sorted(LAYOUT_HEADER)}, not {sorted(data)}")
    for entry in data["layout"]:
        if set(entry) != set(LAYOUT_ENTRY):
            raise TypeError(f"layout keys must be {sorted(LAYOUT_ENTRY)}, not {sorted(entry)}")
    header = (float(data["major_frame_sec"]), data["minor_frames"])
    rows = [(*header, *(e[k] for k in LAYOUT_ENTRY)) for e in data["layout"]]
    return spark.createDataFrame(rows, "major_frame_sec double, minor_frame_count int, name string, description string, parameter_id long, unit string, word int, minor_frames array<int>, hz int, type string")


def ticks(minor_frames: Column, count: Column | int, hz: int) -> Column:
    """Different ticks of a major frame's ``hz`` on which the minor frames fall, sorted."""
    n = count if isinstance(count, Column) else F.lit(count)
    wrong = F.exists(minor_frames, lambda m: (m < 1) | (m > n))
    tick = F.transform(minor_frames, lambda m: F.least(F.lit(hz - 1), F.floor((m - 0.5) / n * hz).cast("int")))
    if hz <= 0:
        raise ValueError("hz must be positive")
    return F.when((n <= 0) | wrong, F.raise_error(F.lit("minor frames must be within 1..minor_frames"))).otherwise(F.array_sort(F.array_distinct(tick)))


def whole_frames(spark: SparkSession, layout: DataFrame, frames: int, hz: int, seed: int = 42, stress: bool = False) -> DataFrame:
    """(seq, ts_monotonic, major_frame, tick, values): one row a frame, with the scheduled parameters, all of them under ``stress``, or none.

    ``seq`` is contiguous. ``values`` is an array of (name, parameter_id, value), by name and
    id. Values are uniform by a hash of seed, seq and id: floats 0 to 1000 with 3 decimals,
    ints 0 to 10000, discretes 0 or 1, other types null. Without a layout a major frame is a second.
    """
    planned = layout.withColumn("ticks", ticks(F.col("minor_frames"), F.col("minor_frame_count"), hz))
    # The layout is one file that the driver validated, so its entries fit one row.
    entry = F.struct("name", "parameter_id", F.lower("type").alias("kind"), "ticks")
    one = planned.agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.coalesce(F.max("major_frame_sec"), F.lit(1.0)).alias("major_sec"))
    clock = spark.range(frames).select(F.col("id").alias("seq"), (F.col("id") / hz).alias("ts_monotonic")).crossJoin(F.broadcast(one))
    within = F.col("ts_monotonic") - F.col("major_frame") * F.col("major_sec")
    timed = clock.withColumn("major_frame", F.floor(F.col("ts_monotonic") / F.col("major_sec")).cast("long")).withColumn("tick", F.least(F.lit(hz - 1), F.floor(within / F.col("major_sec") * hz)).cast("int"))
    due = F.col("entries") if stress else F.filter("entries", lambda e: F.array_contains(e["ticks"], F.col("tick")))

    def value(e: Column) -> Column:
        draw = lambda n: F.pmod(F.xxhash64(F.lit(seed), F.col("seq"), e["parameter_id"]), F.lit(n))
        drawn = F.when(e["kind"] == "float", draw(1_000_001) / 1000.0).when(e["kind"] == "int", draw(10_001).cast("double")).when(e["kind"] == "discrete", draw(2).cast("double"))
        return F.struct(e["name"].alias("name"), e["parameter_id"].alias("parameter_id"), drawn.alias("value"))

    return timed.select("seq", "ts_monotonic", "major_frame", "tick", F.transform(due, value).alias("values"))


def generate_frames(spark: SparkSession, layout: DataFrame, frames: int, hz: int, seed: int = 42, stress: bool = False) -> DataFrame:
    """(seq, ts_monotonic, major_frame, tick, name, parameter_id, value): a row for each value of ``whole_frames``; empty frames give none."""
    return whole_frames(spark, layout, frames, hz, seed, stress).select("seq", "ts_monotonic", "major_frame", "tick", F.inline("values"))


def linear_series(spark: SparkSession, ranges: list[tuple[int, float, float]], seconds: float, per_second: int) -> DataFrame:
    """Points of parameters that run linearly from a minimum to a maximum over the given time."""
    if seconds <= 0 or per_second <= 0:
        raise ValueError("time and rate must be positive")
    steps = max(2, int(seconds * per_second) + 1)
    of = spark.createDataFrame(ranges, "parameter_id long, low double, high double")
    at = spark.range(steps).select((F.col("id") * int(1e9 / per_second)).alias("timestamp_ns"), (F.col("id") / (steps - 1)).alias("r"))
    return at.crossJoin(F.broadcast(of)).select("timestamp_ns", "parameter_id", (F.col("low") + (F.col("high") - F.col("low")) * F.col("r")).alias("value"))
