"""Line dedup, native: sorted hash ranges in, compressed keep bitmaps out.

Line hashes are range-partitioned and sorted by (hash, document, position); one pass
over that order gathers each line's occurrences in a document, and a second, combined
on the map side, counts documents per hash. Only hashes move, never text: a repeated
line's hash is joined back to its occurrences and each document gets a bitmap of the
lines to keep, compressed as runs. The range key includes the document, so a line that
stands in a third of all documents covers many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlake.llm.common import text_of, written

#: Stripped at both ends of a line: space, tab, newline, vertical tab, form feed, return.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else; plain ASCII takes the faster way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return F.trim(line, F.lit(STRIPPED))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def drop_positions(docs: DataFrame, min_length: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, text_hash, dropped): the sorted positions of the lines that a document loses."""
    lines = (
        docs.select("doc_id", text_of().alias("body"))
        .select("doc_id", F.xxhash64("body").alias("text_hash"), F.posexplode(_lines(ascii_lower(F.col("body")))).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_length)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "pos")
    )
    # Hashes are few bytes a line; written, they are not computed again when the ranges are sampled.
    hashes = written(lines, "line_hashes_unsorted")
    ranges = hashes.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "text_hash", "pos")
    held = written(ranges.groupBy("h1", "h2", "doc_id").agg(F.collect_list(F.struct("text_hash", "pos")).alias("at")), "line_hashes")
    common = written(
        held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")).filter(F.col("n_docs") >= min_docs).select("h1", "h2", "last_doc"), "line_common"
    )
    return (
        held.join(common, ["h1", "h2"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        .select("doc_id", F.explode("at").alias("at"))
        .groupBy("doc_id", F.col("at.text_hash").alias("text_hash"))
        .agg(F.sort_array(F.collect_set("at.pos")).alias("dropped"))
    )


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """The keep bitmap of a document, compressed: (start, length) of every run of kept lines."""
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.element_at(dropped, i.cast("int")))
    after = lambda i: F.when(i == F.size(dropped), n_lines).otherwise(F.element_at(dropped, (i + 1).cast("int")))
    runs = F.transform(F.sequence(F.lit(0), F.size(dropped)), lambda i: F.struct((before(i) + 1).alias("start"), (after(i) - before(i) - 1).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def dedup_lines(docs: DataFrame, min_length: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, keep_bitmap, kept_text.

    A line's key is the line stripped of space and ``\\t\\n\\v\\f\\r`` with A-Z lower-cased.
    Keys of at least ``min_length`` code points found in at least ``min_docs`` documents
    stay only in the largest doc_id that holds them, with all their lines there. A null
    or empty text is one empty line. Rows that share one doc_id count as one document;
    null ids too, and a null id is never the largest unless all are null. An empty table
    gives no rows; further columns of ``docs`` are ignored.
    """
    dropped = drop_positions(docs, min_length, min_docs)
    own = docs.select("doc_id", text_of().alias("body")).withColumn("text_hash", F.xxhash64("body")).alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.text_hash") == F.col("x.text_hash"))
    lines = (
        own.join(dropped.alias("x"), on, "left")
        .select("d.doc_id", "d.body", _lines(F.col("d.body")).alias("lines"), F.coalesce("x.dropped", F.expr("CAST(array() AS array<int>)")).alias("dropped"))
        .withColumn("n_lines", F.size("lines"))
        .withColumn("keep_bitmap", keep_runs(F.col("dropped"), F.col("n_lines")))
    )
    kept = F.array_join(F.flatten(F.transform("keep_bitmap", lambda r: F.slice("lines", r["start"] + 1, r["length"]))), "\n")
    return lines.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("n_dropped"),
        "keep_bitmap",
        F.when(F.size("dropped") == 0, F.col("body")).otherwise(kept).alias("kept_text"),
    )
