"""Ranges of an ordered column: buckets of bounded size, so that no window holds a whole stream."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket holds on average.
BUCKET_ROWS = 1 << 18
#: Quantiles are looked up in two steps of at most so many bounds; wider tables have each interval cut evenly further.
FAN_OUT = 64


def place_among(value: Column, lows: list[float]) -> Column:
    """From 1: the place of the last of the rising ``lows`` that is not above ``value``, 1 for less; in two steps of some ``FAN_OUT`` literals."""
    width = max(1, -(-len(lows) // FAN_OUT))
    groups = [lows[i : i + width] for i in range(0, len(lows), width)]
    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    upto = lambda xs: F.greatest(F.lit(1), F.size(F.filter(xs, lambda low: low <= value)))
    outer = upto(array([g[0] for g in groups]))
    return (outer - 1) * width + upto(F.element_at(F.array(*map(array, groups)), outer))


def bucket_of(df: DataFrame, column: str, rows: int = 0) -> Column | None:
    """A monotone bucket number of the numeric ``column`` with about ``rows`` rows of ``df`` each; None if one bucket will do.

    Bounds are quantiles of the whole column, as literals, so that the number depends on the
    value alone and a task that runs again deals its rows alike. Nulls fall into bucket -1.
    """
    rows = rows or BUCKET_ROWS
    value = F.col(column).cast("double")
    s = df.agg(F.count(column).alias("n"), F.min(value).alias("a"), F.max(value).alias("b")).first()
    n = s["n"]
    if n <= rows or s["a"] is None or s["a"] == s["b"]:
        return None
    wanted = -int(-n // rows)
    k = min(wanted, FAN_OUT * FAN_OUT)
    bounds = df.agg(F.percentile_approx(value, [i / k for i in range(1, k)], 20 * k)).first()[0] if k > 1 else []
    lows = [s["a"], *sorted({x for x in bounds if x > s["a"]})]
    spans = [max(b - a, 1e-300) for a, b in zip(lows, [*lows[1:], s["b"]])]
    parts = -(-wanted // k)
    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    at = place_among(value, lows)
    if parts == 1:
        out = at - 1
    else:
        share = (value - F.element_at(array(lows), at)) / F.element_at(array(spans), at)
        out = (at - 1) * parts + F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor(share * parts)))
    return F.when(value.isNull(), -1).otherwise(out).cast("long")


def _same(left: str, right: str, names: list[str]) -> Column:
    return reduce(and_, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names])


def with_previous(df: DataFrame, by: list[str], order: list[str], value: str, name: str, rows: int = 0) -> DataFrame:
    """Adds ``name``: ``value`` of the row before, in order of ``order`` among equal ``by``; null for the first.

    ``order`` starts with a number; a stream is cut into buckets of it, and each bucket's last
    value is handed to the next, so that a hot stream spreads over many tasks. ``value`` has no nulls.
    """
    bucket = bucket_of(df, order[0], rows)
    if bucket is None:
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))
    cut = df.withColumn("_bucket", bucket)
    inside = cut.withColumn(name, F.lag(value).over(Window.partitionBy(*by, "_bucket").orderBy(*order)))
    ends = cut.groupBy(*by, "_bucket").agg(F.max_by(value, F.struct(*order)).alias("_last"))  # one row for a stream and bucket
    handed = ends.withColumn("_handed", F.lag("_last").over(Window.partitionBy(*by).orderBy("_bucket"))).select(*by, "_bucket", "_handed")
    met = inside.alias("i").join(handed.alias("h"), _same("i", "h", [*by, "_bucket"]), "left")
    return met.select(*[F.col(f"i.{c}") for c in df.columns], F.coalesce(f"i.{name}", "h._handed").alias(name))


def with_row_number(df: DataFrame, by: list[str], order: list[str], name: str, rows: int = 0) -> DataFrame:
    """Adds ``name``: the place from 1 in order of ``order`` among equal ``by``, by buckets as in ``with_previous``."""
    bucket = bucket_of(df, order[0], rows)
    if bucket is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    cut = df.withColumn("_bucket", bucket)
    inside = cut.withColumn(name, F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)).cast("long"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    met = inside.alias("i").join(sizes.alias("s"), _same("i", "s", [*by, "_bucket"]))
    return met.select(*[F.col(f"i.{c}") for c in df.columns], (F.col(f"i.{name}") + F.col("s._before")).alias(name))
