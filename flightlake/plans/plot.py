"""Data for flight plots: horizon, altitude reference, bands, scaled series, guide ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlake.functions.scalars import guide_text, scale_to_band, seconds_since, tick_label

# Display bands, their titles and parameters and the ranges they fall back to.
DISPLAY_MIN, DISPLAY_MAX, DETAIL_RATIO = 0.0, 10_000.0, 0.1
BANDS = [
    ("speed", 1_300.0, 3_000.0, 0.0, 500.0, ["IAS", "TAS", "GroundSpeed"]),
    ("vertical_speed", 3_900.0, 5_500.0, -6_000.0, 6_000.0, ["VerticalSpeed"]),
    ("attitude", 6_400.0, 7_900.0, -180.0, 180.0, ["PitchAngle", "RollAngle", "YawAngle"]),
    ("engine_n1", 8_500.0, 9_700.0, 0.0, 110.0, ["Engine1_N1"]),
]
ALTITUDES = ["BaroAltitude", "RadioAltitude"]
TITLES = {"altitude": "Altitude full", "altitude_detail": "Altitude", "speed": "Speed", "vertical_speed": "VSpeed", "attitude": "Attitude", "engine_n1": "Engine N1"}
HIDDEN = "altitude"
BANDS_SCHEMA = "band string, display_min double, display_max double, fallback_min double, fallback_max double, names array<string>"


def horizon(named: DataFrame, target_seconds: float) -> DataFrame:
    """``named`` (timestamp_ns, name, value) with ``seconds`` since the first point, up to the target, inclusive."""
    base = named.agg(F.min("timestamp_ns").alias("base_ns"))  # one row
    timed = named.crossJoin(F.broadcast(base)).withColumn("seconds", seconds_since(F.col("timestamp_ns"), F.col("base_ns")))
    return timed.filter(F.col("seconds") <= target_seconds)


def altitude_reference(named: DataFrame, target_seconds: float) -> DataFrame:
    """One row: the latest barometric, else radio altitude at the target; null or not positive: the greatest of both; at least 1."""
    return _reference(horizon(named, target_seconds))


def _reference(shown: DataFrame) -> DataFrame:
    latest = lambda n: F.max_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.col("timestamp_ns")))
    both = F.max(F.when(F.col("name").isin(*ALTITUDES), F.col("value")))
    found = shown.agg(F.coalesce(*map(latest, ALTITUDES)).alias("found"), F.coalesce(both, F.lit(1.0)).alias("top"))
    return found.select(F.greatest(F.when(F.col("found") > 0, F.col("found")).otherwise(F.col("top")), F.lit(1.0)).alias("reference"))


def band_ranges(named: DataFrame) -> DataFrame:
    """(band, display_min, display_max, raw_min, raw_max): the range of each band's parameters, a fallback without points, widened by 1 if flat."""
    bands = named.sparkSession.createDataFrame(BANDS, BANDS_SCHEMA)  # a handful of rows
    of = bands.select("band", F.explode("names").alias("name"))
    seen = named.join(F.broadcast(of), "name").groupBy("band").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    return bands.join(seen, "band", "left").select(
        "band", "display_min", "display_max", F.coalesce(lo, "fallback_min").alias("raw_min"), F.when(lo.isNull(), F.col("fallback_max")).when(hi <= lo, lo + 1.0).otherwise(hi).alias("raw_max")
    )


def all_bands(shown: DataFrame) -> DataFrame:
    """``band_ranges`` of points within the horizon, and the altitude bands: the full height up to the reference, and its lowest part in detail."""
    band = lambda name, ratio: F.struct(F.lit(name).alias("band"), F.lit(DISPLAY_MIN).alias("display_min"), F.lit(DISPLAY_MAX * ratio).alias("display_max"), F.lit(0.0).alias("raw_min"), (F.col("reference") * ratio).alias("raw_max"))
    altitude = _reference(shown).select(F.inline(F.array(band("altitude", 1.0), band("altitude_detail", DETAIL_RATIO))))
    return altitude.unionByName(band_ranges(shown))


def _bands_of_names(df: DataFrame) -> DataFrame:
    rows = [("altitude", n, k) for k, n in enumerate(ALTITUDES)] + [(b[0], n, k) for b in BANDS for k, n in enumerate(b[5])]
    return df.sparkSession.createDataFrame(rows, "band string, name string, place int")


def scaled_series(named: DataFrame, target_seconds: float) -> DataFrame:
    """(band, name, seconds, value, display_y) of the ten parameters; those without points give no rows."""
    shown = horizon(named, target_seconds)
    joined = shown.join(F.broadcast(_bands_of_names(named)), "name").join(F.broadcast(all_bands(shown)), "band")  # ten rows and six
    y = scale_to_band(F.col("value"), F.col("raw_min"), F.col("raw_max"), F.col("display_min"), F.col("display_max"))
    return joined.select("band", "name", "seconds", "value", y.alias("display_y"))


def guide_ticks(ranges: DataFrame) -> DataFrame:
    """(band, fraction, tick_value, display_y) at a half and zero; the second is left out if it is nearly the first."""
    half = F.col("raw_min") + (F.col("raw_max") - F.col("raw_min")) * 0.5
    near = F.abs(half - F.col("raw_min")) <= F.greatest(1e-9 * F.greatest(F.abs(half), F.abs("raw_min")), F.lit(1e-9))

    def tick(fraction: float) -> Column:
        at = lambda lo, hi: F.col(lo) + (F.col(hi) - F.col(lo)) * fraction
        return F.struct(F.lit(fraction).alias("fraction"), at("raw_min", "raw_max").alias("tick_value"), at("display_min", "display_max").alias("display_y"))

    return ranges.select("band", F.explode(F.when(near, F.array(tick(0.5))).otherwise(F.array(tick(0.5), tick(0.0)))).alias("t")).select("band", "t.*")


def guides(named: DataFrame, target_seconds: float) -> DataFrame:
    """(band, title, series, fraction, tick_value, label, display_y) of all bands but the hidden one.

    ``series`` lists the band's parameters that have points, readable, one a line.
    """
    shown = horizon(named, target_seconds)
    present = shown.select("name").distinct().join(_bands_of_names(named), "name")
    texts = present.groupBy("band").agg(guide_text(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"])).alias("series"))
    ticks = guide_ticks(all_bands(shown).filter(F.col("band") != HIDDEN))
    title = F.element_at(F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair]), F.col("band"))
    return ticks.join(texts, "band", "left").select("band", title.alias("title"), F.coalesce("series", F.lit("")).alias("series"), "fraction", "tick_value", tick_label(F.col("tick_value")).alias("label"), "display_y")


def check(named: DataFrame, known: list[str], target_seconds: float, required: list[str]) -> None:
    """Raises for a target that is not positive, names that the layout lacks, no points, or no altitude within the target."""
    if target_seconds <= 0:
        raise ValueError("the target must be positive")
    if missing := sorted(set(required) - set(known)):
        raise ValueError("missing parameters: " + ", ".join(missing))
    if named.isEmpty():
        raise ValueError("no points to plot")
    if horizon(named, target_seconds).filter(F.col("name").isin(*ALTITUDES)).isEmpty():
        raise ValueError("no altitude in the time asked for")
