"""Exact dedup by skew-safe combining, native.

Texts are equal when identical after deleting space and ``\\t\\n\\v\\f\\r``. Groups form
in three stages, each of them comparing the full normalised text beside its digest:

1. *local*: the map side of the first aggregation combines the copies of a partition;
2. *salted*: copies from ``fan_in`` neighbouring partitions meet, so that a group with a
   third of all rows spreads over as many tasks as there are salts;
3. *global*: only the winner of each salt goes on and the best of those is kept.

A group's row ids travel as one array per salt, of at most ``fan_in`` times
``BLOCK_ROWS`` rows: a salt is a block of neighbouring rows in neighbouring partitions.
An array of salt winners has one entry for so many rows. The verdict goes back to the
salts by a join on ids; no text is joined.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlake.llm.common import text_of, unused, written

#: Rows of an input partition that share a salt.
BLOCK_ROWS = 1 << 12
#: Characters that equality ignores: space, tab, newline, vertical tab, form feed, return.
IGNORED = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without ignored characters."""
    return F.translate(text, IGNORED, "")


def _rows(docs: DataFrame, fan_in: int) -> DataFrame:
    """(member, body, salt, digest): what orders a row in its group, and its group."""
    block = F.floor(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) / F.lit(BLOCK_ROWS))  # the low bits count a partition's rows
    return docs.select(
        F.struct((-F.length(text_of())).alias("shorter"), F.col("doc_id").alias("id")).alias("member"),
        normalised(text_of()).alias("body"),
        F.struct(F.floor(F.spark_partition_id() / F.lit(fan_in)).alias("part"), block.alias("block")).alias("salt"),
    ).withColumn("digest", F.sha2("body", 256))


def exact_groups(docs: DataFrame, fan_in: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in its original text stays, then
    the smallest doc_id (a null id sorts first). A null text is empty, and all empty
    texts are one group. Of repeated rows with one id exactly one is ``kept``. An empty
    table gives no rows; further columns of ``docs`` are ignored, whatever their names.
    """
    rows = _rows(docs, fan_in)
    # One aggregate only: both uses below then read the same exchange.
    salted = (
        rows.groupBy("digest", "body", "salt")
        .agg(F.sort_array(F.collect_list("member")).alias("members"))
        .select("digest", "body", "salt", "members", F.col("members")[0].alias("best"))
    )
    winners = (
        salted.groupBy("digest", "body")
        .agg(F.collect_list(F.struct("best.shorter", "best.id", "salt", F.size("members").cast("long").alias("n"))).alias("salts"))
        .select(
            "digest",
            F.array_min("salts").alias("top"),
            F.aggregate("salts", F.lit(0).cast("long"), lambda n, s: n + s["n"]).alias("group_size"),
            F.explode("salts").alias("of"),
        )
        .select("digest", "top", "group_size", F.col("of.salt").alias("salt"), F.col("of.shorter").alias("shorter"), F.col("of.id").alias("id"))
    )
    a, b = salted.alias("a"), winners.alias("b")
    # Null-safe throughout: filters that Catalyst would infer for one side only cost the reuse.
    same = [("a.digest", "b.digest"), ("a.salt", "b.salt"), ("a.best.shorter", "b.shorter"), ("a.best.id", "b.id")]
    same = reduce(and_, [F.col(x).eqNullSafe(F.col(y)) for x, y in same])
    return a.join(b, same).select(
        F.posexplode("a.members").alias("at", "member"), "b.top", "b.group_size", F.col("a.salt").alias("salt"), F.col("a.digest").alias("text_sha256")
    ).select(
        F.col("member.id").alias("doc_id"),
        F.col("top.id").alias("keep_id"),
        "group_size",
        ((F.col("at") == 0) & (F.col("salt") == F.col("top.salt"))).alias("kept"),
        "text_sha256",
    )


def keep_unique(docs: DataFrame, fan_in: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged.

    The winners form in the same three stages; no other row's id is gathered, so text goes
    through two exchanges for them and one for the columns. Of repeated rows with one
    id, text length and digest one stays. A null text is empty. An empty table gives no
    rows. Who goes for whom stays beside, in the written table ``exact_classes-*`` of the
    shared folder: doc_id, text_sha256, keep_id.
    """
    winner = F.min("member").alias("member")
    best = _rows(docs, fan_in).groupBy("digest", "body", "salt").agg(winner).groupBy("digest", "body").agg(winner)
    key = lambda doc_id, shorter, digest: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), shorter, digest)
    stay = written(best.select("digest", F.col("member.id").alias("id"), F.col("member.shorter").alias("shorter")), "exact_kept")
    digest, name = F.sha2(normalised(text_of()), 256), unused("key", docs.columns)
    rows = docs.select(F.col("doc_id"), digest.alias("digest"))
    # Ids and digests only; a kept text stands once, so its copies can be split at runtime.
    written(rows.join(stay.select("digest", F.col("id").alias("keep_id")), "digest").select("doc_id", F.col("digest").alias("text_sha256"), "keep_id"), "exact_classes")
    own = docs.withColumn(name, key(F.col("doc_id"), -F.length(text_of()), digest))
    return own.join(stay.select(key(F.col("id"), F.col("shorter"), F.col("digest")).alias(name)), name, "left_semi").dropDuplicates([name]).select(*docs.columns)
