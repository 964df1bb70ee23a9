"""Points: filters, newest-wins merge, aggregates, frames to points, dimension lookups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlake.schemas import AGGREGATE_COLUMNS, MAX_PARAMETER_ID, POINT_COLUMNS

#: Above this many ids a filter becomes a semi join with the ids as a table.
ID_LIST = 1000
#: Points of one run that a version can number, and runs.
ORDINAL_BITS = 40


def in_time(start_ns: int, end_ns: int) -> Column:
    """Half-open ``[start, end)``; an inverted or empty range holds nothing."""
    return (F.col("timestamp_ns") >= start_ns) & (F.col("timestamp_ns") < end_ns)


def filter_parameters(points: DataFrame, ids: Iterable[int] | None) -> DataFrame:
    """None: all points; an empty set: none; else the points of these parameters."""
    if ids is None:
        return points
    ids = sorted(set(ids))
    if not ids:
        return points.filter(F.lit(False))
    if len(ids) <= ID_LIST:
        return points.filter(F.col("parameter_id").isin(ids))
    wanted = points.sparkSession.createDataFrame([(i,) for i in ids], "parameter_id long")
    return points.join(wanted, "parameter_id", "left_semi")  # Spark broadcasts the ids if their size allows


def version(run_id: Column, ordinal: Column) -> Column:
    """One BIGINT that orders points by run, then by arrival: a fixed-width key keeps the hash aggregate.

    A run or an ordinal beyond its width fails the query instead of passing for another run.
    """
    run, place = run_id.cast("long"), ordinal.cast("long")
    fits = run.between(0, (1 << (63 - ORDINAL_BITS)) - 1) & place.between(0, (1 << ORDINAL_BITS) - 1)
    return F.when(fits, F.shiftleft(run, ORDINAL_BITS) + place).otherwise(F.raise_error(F.lit("run or ordinal too large for a version")).cast("long"))


def newest_wins(versioned: DataFrame) -> DataFrame:
    """One point per (timestamp_ns, parameter_id): that of the latest run, then the latest arrival."""
    newest = F.max_by("value", version(F.col("run_id"), F.col("ordinal"))).alias("value")
    return versioned.groupBy("timestamp_ns", "parameter_id").agg(newest)


def in_key_order(points: DataFrame) -> DataFrame:
    return points.select(*POINT_COLUMNS).orderBy("timestamp_ns", "parameter_id")


def query_range(versioned: DataFrame, start_ns: int, end_ns: int, ids: Iterable[int] | None = None, ordered: bool = False) -> DataFrame:
    """Filter, then newest-wins; the filters are on key columns only, so they reach the scan.

    In key order if ``ordered``: ranges of keys then serve both the aggregate and the sort, in one exchange.
    """
    kept = filter_parameters(versioned.filter(in_time(start_ns, end_ns)), ids)
    return in_key_order(newest_wins(kept.repartitionByRange("timestamp_ns", "parameter_id"))) if ordered else newest_wins(kept).select(*POINT_COLUMNS)


def _first_nan(extreme: Column) -> Column:
    """NaN if the earliest value is NaN, else the extreme of the other values."""
    return F.when(F.isnan(F.min_by("value", "timestamp_ns")), F.lit(float("nan"))).otherwise(extreme)


def aggregate_points(points: DataFrame, start_ns: int, end_ns: int, ids: Iterable[int] | None = None) -> DataFrame:
    """count, min, max, avg by parameter; start and end are labels and filter nothing.

    With ``ids`` every id appears, without points with count 0 and nulls.
    """
    known = F.when(~F.isnan("value"), F.col("value"))
    out = filter_parameters(points, ids).groupBy("parameter_id").agg(
        F.count(F.lit(1)).alias("count"), _first_nan(F.min(known)).alias("min"), _first_nan(F.max(known)).alias("max"), F.avg("value").alias("avg")
    )
    if ids is not None:
        wanted = points.sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], "parameter_id long")
        out = wanted.join(out, "parameter_id", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    return out.withColumn("start_ts_ns", F.lit(start_ns).cast("long")).withColumn("end_ts_ns", F.lit(end_ns).cast("long")).select(*AGGREGATE_COLUMNS)


#: Fixed value: the aggregates' names.
AGGREGATES = ("min", "max", "avg", "count")


def broken_aggregates(aggregates: DataFrame) -> DataFrame:
    """The rows that no aggregate can give: a negative count, values without points, or points without values."""
    values = [F.col(c).isNull() for c in ("min", "max", "avg")]
    none, some = values[0] & values[1] & values[2], ~(values[0] | values[1] | values[2])
    return aggregates.filter(F.col("count").isNull() | (F.col("count") < 0) | ((F.col("count") == 0) & ~none) | ((F.col("count") > 0) & ~some))


def aggregate_range(versioned: DataFrame, start_ns: int, end_ns: int, ids: Iterable[int] | None = None) -> DataFrame:
    """Newest-wins first, then the aggregate."""
    return aggregate_points(query_range(versioned, start_ns, end_ns, ids), start_ns, end_ns, ids)


def normalise_frames(frames: DataFrame, clock: Column | None = None) -> DataFrame:
    """Frames to rows of points: entries need an integer id and a numeric value, frames without one give no row.

    ``clock`` stands in for a missing ``ts_monotonic``. Seconds become nanoseconds by
    truncation, as the float product does; a time that is NaN or beyond BIGINT drops its
    frame. Ids outside unsigned 32 bits are dropped too.
    """
    seconds = F.coalesce("ts_monotonic", clock) if clock is not None else F.col("ts_monotonic")
    entry = F.transform(F.map_values("values"), lambda v: F.struct(v["parameter_id"].try_cast("long").alias("parameter_id"), v["value"].try_cast("double").alias("value")))
    valid = F.filter(entry, lambda e: e["parameter_id"].between(0, MAX_PARAMETER_ID) & e["value"].isNotNull())
    rows = frames.withColumn("columns", valid).withColumn("timestamp_ns", (seconds * F.lit(1e9)).try_cast("long"))
    return rows.filter((F.size("columns") > 0) & F.col("timestamp_ns").isNotNull()).drop("values")


def flatten_rows(rows: DataFrame) -> DataFrame:
    """Each pair of a row becomes a point; rows without pairs give none. Other columns stay."""
    rest = [c for c in rows.columns if c != "columns"]
    return rows.select(*rest, F.inline("columns"))


def with_parameters(points: DataFrame, parameters: DataFrame) -> DataFrame:
    """Inner join with the parameter dimension; Spark broadcasts it if its size allows."""
    return points.join(parameters, "parameter_id")


def missing_names(parameters: DataFrame, names: Iterable[str]) -> DataFrame:
    """Required names that the dimension lacks, sorted."""
    wanted = parameters.sparkSession.createDataFrame([(n,) for n in sorted(set(names))], "name string")
    return wanted.join(parameters.select("name"), "name", "left_anti").orderBy("name")


def as_of(points: DataFrame, at_ns: int) -> DataFrame:
    """Each parameter's latest value at or before a time, inclusive."""
    return points.filter(F.col("timestamp_ns") <= at_ns).groupBy("parameter_id").agg(F.max_by("value", "timestamp_ns").alias("value"), F.max("timestamp_ns").alias("timestamp_ns"))


def run_catalog(versioned: DataFrame) -> DataFrame:
    """Zone maps of runs."""
    return versioned.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("point_count"), F.min("timestamp_ns").alias("min_timestamp_ns"), F.max("timestamp_ns").alias("max_timestamp_ns"),
        F.min("parameter_id").alias("min_parameter_id"), F.max("parameter_id").alias("max_parameter_id"),
    )


def may_hold(start_ns: int, end_ns: int, ids: Iterable[int] | None) -> Column:
    """Zone-map predicate: the run may hold points of the range and of one of the ids."""
    out = (F.col("max_timestamp_ns") >= start_ns) & (F.col("min_timestamp_ns") < end_ns)
    if ids is None:
        return out
    inside = F.lit(False)
    for i in sorted(set(ids)):
        inside = inside | ((F.col("min_parameter_id") <= i) & (F.col("max_parameter_id") >= i))
    return out & inside
