"""Scalar expressions: scaling, easing, profiles, percentiles, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_since(ts: Column, base: Column) -> Column:
    return (ts - base) / F.lit(1e9)


def scale_to_band(value: Column, raw_min: Column, raw_max: Column, low: Column, high: Column) -> Column:
    """Clamped linear scaling into a display band; a degenerate raw range gives the middle."""
    ratio = F.least(F.greatest((value - raw_min) / F.nullif(raw_max - raw_min, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(raw_max <= raw_min, (low + high) / 2).otherwise(low + (high - low) * ratio)


def smooth_step(t: Column, t0: float, t1: float, v0: float, v1: float) -> Column:
    """Eased from v0 at t0 to v1 at t1, flat outside; without length the end value."""
    if t1 <= t0:
        return F.lit(float(v1))
    r = F.least(F.greatest((t - t0) / (t1 - t0), F.lit(0.0)), F.lit(1.0))
    return F.lit(float(v0)) + (v1 - v0) * r * r * (3 - 2 * r)


def piecewise(t: Column, segments: list[tuple[float, float, float, float]]) -> Column:
    """The first segment (t0, t1, v0, v1) with t <= t1, after the last its end value."""
    return reduce(lambda rest, s: F.when(t <= s[1], smooth_step(t, *s)).otherwise(rest), reversed(segments), F.lit(float(segments[-1][3])))


def percentile(column: str, q: float) -> Column:
    """Inclusive linear interpolation; 0.0 for no rows.

    Exact, so a task keeps the different values of its group with their counts; the figures
    it is meant for are latencies of a benchmark, not raw points.
    """
    return F.coalesce(F.percentile(column, F.lit(q)), F.lit(0.0))


def tick_label(value: Column) -> Column:
    """Numbers that are nearly whole without decimals, others with one."""
    whole = F.bround(value)
    near = F.abs(value - whole) <= F.greatest(1e-9 * F.greatest(F.abs(value), F.abs(whole)), F.lit(1e-9))
    return F.when(near, F.format_string("%d", whole.cast("long"))).otherwise(F.format_string("%.1f", value))


# Names that are written out in labels.
READABLE = {"GroundSpeed": "Ground speed", "VerticalSpeed": "Vertical speed", "Engine1_N1": "Engine1 N1"}


def readable(name: Column) -> Column:
    """The name as labels write it."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in READABLE.items() for x in pair]), name), name)


def guide_text(names: Column) -> Column:
    """An array of names, readable, one a line."""
    return F.array_join(F.transform(names, readable), "\n")
