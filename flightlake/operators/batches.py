"""Greedy batches of an ordered stream, in time linear in its rows and memory of one bucket.

A batch closes with the row that fills its rows or its size, and before the first row that
comes ``max_age`` or more after the batch's first; a limit of 0 or less is off. Where a batch
ends depends on where it began, so a stream cannot be cut at will. But in a bucket of the
stream the first close decides all later ones, and only rows within the limits from the
bucket's start can be the first close. So each bucket says for each such row how the bucket
then ends and how many batches close; following that through the buckets, a few numbers
each, tells what every bucket begins with; and then all buckets are numbered side by side.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlake.operators.ranges import bucket_of

#: Rows of a stream that one task holds at a time, about.
BUCKET_ROWS = 1 << 18


class Limits(NamedTuple):
    rows: int = 0
    size: int = 0
    age: int = 0


class Open(NamedTuple):
    """A batch that is open: its rows and size so far, and the time it began at (nothing if it has no rows)."""

    rows: int = 0
    size: int = 0
    began: int | None = None


class Bucket:
    """The rows of one bucket, in order: running sums of their rows and sizes, and their times."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, times: np.ndarray, limits: Limits):
        self.rows, self.sizes = (np.concatenate([[0], np.cumsum(x)]).astype(np.int64) for x in (rows, sizes))
        self.times, self.limits, self.n = times.astype(np.int64), limits, len(times)

    def first_close(self, begin: Open) -> int:
        """The last row of the batch open at the start; -1 if it ends before row 0, the number of rows if it stays open."""
        at, limits = self.n, self.limits
        if limits.rows > 0:
            at = min(at, int(np.searchsorted(self.rows[1:], limits.rows - begin.rows)))
        if limits.size > 0:
            at = min(at, int(np.searchsorted(self.sizes[1:], limits.size - begin.size)))
        if limits.age > 0 and self.n:
            late = int(np.searchsorted(self.times, (self.times[0] if begin.began is None else begin.began) + limits.age))
            if late < self.n:
                at = min(at, late - 1)
        return at

    def closes(self) -> np.ndarray:
        """For each row the last row of the batch that begins with it."""
        at, limits = np.full(self.n, self.n), self.limits
        if limits.rows > 0:
            at = np.minimum(at, np.searchsorted(self.rows[1:], self.rows[:-1] + limits.rows))
        if limits.size > 0:
            at = np.minimum(at, np.searchsorted(self.sizes[1:], self.sizes[:-1] + limits.size))
        if limits.age > 0:
            late = np.searchsorted(self.times, self.times + limits.age)
            at = np.where(late < self.n, np.minimum(at, late - 1), at)
        return at

    def open_from(self, i: int) -> Open:
        """The open batch at the end if it began with row ``i``."""
        return Open(int(self.rows[-1] - self.rows[i]), int(self.sizes[-1] - self.sizes[i]), int(self.times[i])) if i < self.n else Open()

    def ends(self) -> list[tuple[Open, int]]:
        """For each row, and beyond the last: what is open at the end if a batch begins there, and how many closed till then."""
        closes, out = self.closes(), [(Open(), 0)] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            after = int(closes[i]) + 1
            out[i] = (out[after][0], out[after][1] + 1) if after <= self.n else (self.open_from(i), 0)
        return out

    def numbers(self, begin: Open) -> np.ndarray:
        """The batch of each row, 0 for the one open at the start."""
        out, closes = np.empty(self.n, np.int64), self.closes()
        i, batch, last = 0, 0, self.first_close(begin)
        while i < self.n:
            out[i : last + 1] = batch
            i, batch = last + 1, batch + 1
            last = int(closes[i]) if i < self.n else self.n
        return out


def summary(bucket: Bucket) -> list[tuple]:
    """(row, rows, size, time, open rows, open size, open began, closed): first the whole bucket as row -2, what stays open if nothing closes.

    Then each row that can be the first close, -1 for a close before them, with the sums up
    to it; and the row after these for its time.
    """
    whole = bucket.open_from(0)
    out = [(-2, whole.rows, whole.size, 0, 0, 0, whole.began, 0)]
    ends, last = bucket.ends(), bucket.first_close(Open())
    for i in range(-1, min(bucket.n, last + 2)):
        if i > last:
            end, closed = Open(), 0
        else:
            end, closed = ends[i + 1][0], ends[i + 1][1] + 1
        out.append((i, int(bucket.rows[i + 1]), int(bucket.sizes[i + 1]), int(bucket.times[i]) if i >= 0 else 0, end.rows, end.size, end.began, closed))
    return out


def follow(rows: list[tuple], begin: Open, limits: Limits) -> tuple[Open, int]:
    """What is open after a bucket, from its ``summary``, and how many batches closed in it."""
    whole, before, *own = rows
    at = len(own)
    for limit, have, k in ((limits.rows, begin.rows, 1), (limits.size, begin.size, 2)):
        if limit > 0:
            at = min(at, int(np.searchsorted([r[k] for r in own], limit - have)))
    if limits.age > 0 and own:
        late = int(np.searchsorted([r[3] for r in own], (own[0][3] if begin.began is None else begin.began) + limits.age))
        if late < len(own):
            at = min(at, late - 1)
    if at == len(own):  # nothing closes
        began = whole[6] if begin.began is None else begin.began
        return Open(begin.rows + whole[1], begin.size + whole[2], began), 0
    end = own[at] if at >= 0 else before
    return Open(end[4], end[5], end[6]), end[7]


_SUMMARY = ["row", "rows", "size", "time", "open_rows", "open_size", "began", "closed"]


def greedy_groups(df: DataFrame, by: str, order: str, size: str, limits: Limits, name: str = "batch_id", rows: str | None = None, time: str | None = None) -> DataFrame:
    """(by, order, size, name): the number of the batch that each row falls into, from 0 in each stream ``by``.

    ``order`` is a number, unique in a stream; ``size``, and ``rows`` (1 if not named), are
    whole numbers that are not negative; ``time`` rises with ``order``. An empty table gives
    no rows, a null stream is one stream, and further columns are ignored.
    """
    own = df.select(
        F.col(by).alias("s"), F.col(order).alias("o"), F.col(size).cast("long").alias("n"),
        (F.lit(1) if rows is None else F.col(rows)).cast("long").alias("r"), (F.lit(0) if time is None else F.col(time)).cast("long").alias("t"),
    )
    at = bucket_of(own, "o", BUCKET_ROWS)
    cut = own.withColumn("b", F.lit(0).cast("long") if at is None else at)
    kind = dict(df.dtypes)
    bucket = lambda g: Bucket(g["r"].to_numpy(), g["n"].to_numpy(), g["t"].to_numpy(), limits)
    opened = lambda r: Open(int(r["rows"]), int(r["size"]), None if pd.isna(r["began"]) else int(r["began"]))

    def summarise(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(summary(bucket(group.sort_values("o"))), columns=_SUMMARY).astype({"began": "Int64"})
        return found.assign(s=key[0], b=key[1])[["s", "b", *_SUMMARY]]

    def chain(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out, begin, batch = [], Open(), 0
        for b, found in group.groupby("b", sort=True):
            out.append((key[0], b, begin.rows, begin.size, begin.began, batch))
            found = found.sort_values("row")[_SUMMARY].astype(object).where(found.sort_values("row")[_SUMMARY].notna(), None)
            begin, closed = follow([tuple(r) for r in found.itertuples(index=False)], begin, limits)
            batch += closed
        return pd.DataFrame(out, columns=["s", "b", "rows", "size", "began", "batch"]).astype({"began": "Int64"})

    def number(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, begin = left.sort_values("o"), right.iloc[0]
        return left.assign(k=bucket(left).numbers(opened(begin)) + int(begin["batch"]))[["s", "o", "n", "k"]]

    of = kind[by]
    summaries = cut.groupBy("s", "b").applyInPandas(summarise, f"s {of}, b long, " + ", ".join(f"{c} long" for c in _SUMMARY))
    begins = summaries.groupBy("s").applyInPandas(chain, f"s {of}, b long, rows long, size long, began long, batch long")
    numbered = cut.groupBy("s", "b").cogroup(begins.groupBy("s", "b")).applyInPandas(number, f"s {of}, o {kind[order]}, n long, k long")
    return numbered.select(F.col("s").alias(by), F.col("o").alias(order), F.col("n").alias(size), F.col("k").alias(name))
