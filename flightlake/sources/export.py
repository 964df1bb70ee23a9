"""CSV of points and aggregates, as Python's csv module writes it: CRLF, repr floats, null empty."""

from __future__ import annotations

import csv
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame

from flightlake.schemas import AGGREGATE_COLUMNS, POINT_COLUMNS


def _write(df: DataFrame, columns: list[str], target: str | Path | TextIO) -> None:
    if not hasattr(target, "write"):
        with open(target, "w", encoding="utf-8", newline="") as f:
            return _write(df, columns, f)
    out = csv.writer(target)
    out.writerow(columns)
    for r in df.select(*columns).toLocalIterator():  # one partition at a time
        out.writerow(["" if x is None else x for x in r])


def write_points_csv(points: DataFrame, target: str | Path | TextIO) -> None:
    _write(points.orderBy("timestamp_ns", "parameter_id"), POINT_COLUMNS, target)


def write_aggregates_csv(aggregates: DataFrame, target: str | Path | TextIO) -> None:
    _write(aggregates.orderBy("parameter_id"), AGGREGATE_COLUMNS, target)


def lines(df: DataFrame) -> list[str]:
    """Rows for a terminal: no header, comma-joined, null empty."""
    return [",".join("" if x is None else str(x) for x in r) for r in df.toLocalIterator()]
