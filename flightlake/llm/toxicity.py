"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A feature is a hashed n-gram of the lower-cased text with white space folded, present or
not; every n-gram is one, none is left out. Its scale is the log of how much more often
toxic texts have it than others, with pseudo-rows that pull what is rare to no difference.
A logistic regression weighs the scaled features. While it is fitted, a row's own label is
left out of the ratios it sees: else each text's unique n-grams would give its label away
and the regression would learn to trust them.

The classifier is fitted by one task on a sample of labelled rows that ``MAX_ROWS`` and
``MAX_CHARS`` bound; scores cover whole texts of all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightlake.llm.common import held_out, text_of

#: Length of the n-grams; 6 did best of 4 to 8 and their mixtures in cross-validation on rows that are not held out.
SIZE = 6
HASH_BITS = 20
#: The sample: labelled rows with the least hash of their id, as many as these rows and code points allow.
MAX_ROWS, MAX_CHARS = 6_000, 48_000_000
#: Pseudo-rows of every n-gram, dealt over the classes as the sample is; chosen by cross-validation as well.
SMOOTHING = 100.0
L2 = 0.3
#: A missed toxic text counts as so many false alarms.
TOXIC_WEIGHT = 2.0
STEPS, MEMORY = 25, 6
THRESHOLD = 0.3
#: Code points hashed at a time, and features of the sample weighed at a time.
CHUNK, BLOCK = 1 << 20, 1 << 20

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hashes(text: str) -> Iterator[np.ndarray]:
    """Hashes of the text's n-grams, repeats included, part by part."""
    plain = f" {' '.join(text.lower().split())} "
    for at in range(0, len(plain) - SIZE + 1, CHUNK):
        part = np.frombuffer(plain[at : at + CHUNK + SIZE - 1].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        n = len(part) - SIZE + 1
        h = np.full(n, SIZE, np.uint64)
        for i in range(SIZE):
            h = (h ^ part[i : i + n]) * _FACTOR
            h ^= h >> np.uint64(29)
        yield (h >> np.uint64(64 - HASH_BITS)).astype(np.int32)


def features(text: str) -> np.ndarray:
    """Different hashed n-grams of a text, at most as many as there are hashes."""
    out = np.empty(0, np.int32)
    for h in _hashes(text):
        h = np.concatenate([out, h])
        h.sort()
        out = h[np.flatnonzero(np.diff(h, prepend=-1))]
    return out


class Model:
    """A weight (ratio times coefficient) for every hash, and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights[features(text)].sum(dtype=np.float64))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_chars: int = MAX_CHARS) -> DataFrame:
    """(place, doc_id, body, toxic) of labelled rows that are not held out, in order of their ids' hashes, within both bounds.

    Rows without a label or an id are none; a doc_id with several labels counts by the
    greatest; a doc_id with several texts counts with each. The first text always stays.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    usable = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(max_rows)
    # At most max_rows rows of three numbers: bounded, so they may be broadcast.
    met = docs.select(F.col("doc_id").alias("id"), text_of().alias("body")).join(F.broadcast(chosen), F.col("id") == F.col("doc_id"))
    rows = met.select("place", "doc_id", "body", "toxic", F.xxhash64("body").alias("text_hash"))
    # Of a doc_id that stands in many rows the rows with the least hashes count, so the running sum has at most twice max_rows rows.
    few = rows.orderBy("place", "doc_id", "text_hash").limit(2 * max_rows)
    before = F.sum(F.length("body")).over(Window.orderBy("place", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1))
    return few.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < max_chars).drop("before")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """The classifier; with one class or none, the smoothed share of toxic rows is all it knows.

    Further columns of either table are ignored. The driver gets the weights, of fixed size.
    """
    found = pa.schema([("place", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("at", pa.list_(pa.int32())), ("toxic", pa.int32())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                own = [features(t.as_py()) for t in part.column("body")]
                at = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate(own)))
                yield pa.RecordBatch.from_arrays([part.column("place"), part.column("doc_id"), part.column("text_hash"), at, part.column("toxic")], schema=found)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, sizes, toxic = [], [], []
        for batch in batches:
            at = batch.column("at")
            columns.append(at.flatten().to_numpy())
            sizes.append(np.diff(at.offsets.to_numpy()))
            toxic.append(batch.column("toxic").to_numpy())
        join = lambda xs, kind: np.concatenate(xs).astype(kind, copy=False) if xs else np.empty(0, kind)
        weights, bias = regress(join(columns, np.int32), join(sizes, np.int64), join(toxic, np.float64))
        yield pa.RecordBatch.from_pydict({"weights": [weights.astype(np.float32).tobytes()], "bias": [bias]})

    rows = sample(docs, labels, max_rows, max_chars).select(F.col("place"), F.col("doc_id").cast("long").alias("doc_id"), "text_hash", "body", "toxic")
    own = rows.repartition("doc_id").mapInArrow(hashed, "place long, doc_id long, text_hash long, at array<int>, toxic int")
    # One task holds the bounded sample's features, in an order that does not depend on the tasks before it.
    fitted = own.repartition(1).sortWithinPartitions("place", "doc_id", "text_hash").mapInArrow(train, "weights binary, bias double").first()
    if fitted is None:  # no partition, no task
        return Model(*regress(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0)))
    return Model(np.frombuffer(bytes(fitted["weights"]), np.float32), fitted["bias"])


def ratios(toxic: np.ndarray, rows: np.ndarray, p: float, n: float) -> np.ndarray:
    """Log ratio of the shares of toxic and other rows that have a feature; ``p`` of ``n`` rows are toxic."""
    share = p / n
    return np.log((toxic + SMOOTHING * share) / p) - np.log((rows - toxic + SMOOTHING * (1 - share)) / (n - p))


def regress(columns: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients times ratios of all hashes, and the bias; row i has the next ``sizes[i]`` of ``columns`` and the label ``y[i]``.

    Minimises the weighted log loss plus an L2 term of the coefficients by L-BFGS.
    """
    width, n, p = 1 << HASH_BITS, len(y), float(y.sum())
    if not 0 < p < n:
        share = (p + 1) / (n + 2)
        return np.zeros(width), math.log(share / (1 - share))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    cuts = [0]  # blocks of rows with about BLOCK features
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + BLOCK, "right")) - 1))
    blocks = [(a, b, columns[ends[a] : ends[b]]) for a, b in zip(cuts, cuts[1:])]
    row_of = [np.repeat(np.arange(b - a, dtype=np.int32), sizes[a:b]) for a, b, _ in blocks]
    rows, toxic = np.zeros(width), np.zeros(width)
    for (a, b, at), row in zip(blocks, row_of):
        rows += np.bincount(at, minlength=width)
        toxic += np.bincount(at, y[a:b][row], width)
    # What each row sees: the ratios without its own label.
    seen = [ratios(toxic[at] - y[a:b][row], rows[at] - 1, p, n).astype(np.float32) for (a, b, at), row in zip(blocks, row_of)]
    weight = np.where(y > 0, TOXIC_WEIGHT, 1.0)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, bias, total, gradient = x[:-1], x[-1], 0.0, np.zeros(width + 1)
        for (a, b, at), row, scale in zip(blocks, row_of, seen):
            z = np.bincount(row, scale * w[at], b - a) + bias
            total += float((weight[a:b] * (np.logaddexp(0, z) - y[a:b] * z)).sum())
            g = weight[a:b] * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[a:b])
            gradient[:-1] += np.bincount(at, scale * g[row], width)
            gradient[-1] += g.sum()
        return total / n + L2 / 2 / n * float(w @ w), gradient / n + np.append(L2 / n * w, 0.0)

    x = np.zeros(width + 1)
    x[-1] = math.log((p + 1) / (n - p + 1))
    value, gradient = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        direction, parts = gradient.copy(), []
        for s, d in reversed(steps):
            parts.append(s @ direction / (d @ s))
            direction -= parts[-1] * d
        direction *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, float(np.linalg.norm(gradient)))
        for (s, d), part in zip(steps, reversed(parts)):
            direction += s * (part - d @ direction / (d @ s))
        slope, length = float(gradient @ direction), 1.0
        for _ in range(30):
            x2 = x - length * direction
            value2, gradient2 = loss(x2)
            if value2 <= value - 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        if (x2 - x) @ (gradient2 - gradient) > 1e-12:
            steps = [*steps[1 - MEMORY :], (x2 - x, gradient2 - gradient)]
        small = value - value2 < 1e-7
        x, value, gradient = x2, value2, gradient2
        if small:
            break
    return x[:-1] * ratios(toxic, rows, p, n), float(x[-1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (score at the threshold or above).

    A null text is empty and scores like a text without features. Repeated rows each give
    a row; an empty table gives none; further columns of ``docs`` are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_of().alias("body"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
