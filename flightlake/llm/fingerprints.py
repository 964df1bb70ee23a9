"""Document fingerprints, native: a canonical exact digest.

A text's canonical form is NFKC, case-folded, NFKC again, with runs of white space folded
to one space and none at the ends. The fingerprint is a wide xxhash of that form: two
xxhash64 with different seeds, 128 bits. Equal hashes form a bucket, and inside buckets of
two or more the canonical bytes are compared: a second form with the same hash would get a
suffix of its own, so equal fingerprints mean equal canonical texts. The likeness of two
fingerprints is 1 if they are equal and 0 otherwise.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightlake.llm.common import text_of, written
from flightlake.operators.ranges import place_among

#: Bytes of text that a bucket of neighbouring ids holds on average: a part of the table, within these bounds.
BUCKET_SHARE, LEAST_BUCKET, MOST_BUCKET = 1 / 2000, 2 << 20, 256 << 20
#: Buckets, a row of three numbers each, that are broadcast; more, as tables far over 100 TB have, meet their documents by a shuffle.
MOST_EDGES = 1 << 20
#: Quantiles of ids that are looked up; each is cut evenly further in larger tables.
QUANTILES = 4096


def canonical(text: Column) -> Column:
    nfkc = lambda x: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"(?U)[\s\p{Z}]+", " "))


def wide_hash(canon: Column) -> Column:
    """32 lowercase hex digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), canon)), 16, "0") for seed in (1, 2)]))


def _cuts(docs: DataFrame) -> tuple[list[float], list[int], list[bool], int]:
    """(first ids of intervals, buckets of each, whether it holds one id alone, buckets of null ids).

    An id that takes several quantiles gets an interval of its own, which is cut by the texts' hashes.
    """
    n = docs.agg(
        F.sum(F.octet_length("body")).alias("bytes"), F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")
    ).first()
    size = (n["bytes"] or 0) + n["rows"]
    wanted = max(1, -int(-size // min(MOST_BUCKET, max(LEAST_BUCKET, size * BUCKET_SHARE))))
    nulls = max(1, -(-wanted * (n["rows"] - n["ids"]) // max(1, n["rows"])))
    if n["a"] is None:
        return [], [], [], nulls
    k = min(wanted, QUANTILES)
    found = docs.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 20 * k)).first()[0] if k > 1 else []
    taken = Counter(found)
    hot = {x for x, c in taken.items() if c > 1}
    lows = sorted({n["a"], *taken, *(x + 1 for x in hot if x < n["b"])})
    each = -(-wanted // k)
    alone = [x in hot and (i + 1 == len(lows) or lows[i + 1] == x + 1) for i, x in enumerate(lows)]
    return [float(x) for x in lows], [each * taken.get(x, 1) if one else each for x, one in zip(lows, alone)], alone, nulls


def _buckets(docs: DataFrame) -> tuple[Column, DataFrame]:
    """The bucket of a row of (doc_id, text_hash), rising in that order, and (first_id, first_hash, before): each bucket's first row and the bucket before."""
    lows, parts, alone, nulls = _cuts(docs)
    # Texts' hashes fall evenly, so equal ranges of them are equal parts.
    by_hash = (F.col("text_hash").cast("double") + float(1 << 63)) / float(1 << 64)
    share = lambda x, n: F.least(n - 1, F.greatest(F.lit(0), F.floor(x * n)))
    bucket = share(by_hash, F.lit(nulls)) - nulls
    if lows:
        value, array = F.col("doc_id").cast("double"), lambda xs: F.array(*map(F.lit, xs))
        spans = [max(1.0, b - a) for a, b in zip(lows, [*lows[1:], lows[-1] + 1])]
        at = place_among(value, lows)
        if any(p > 1 for p in parts):
            before = list(accumulate(parts, initial=0))[:-1]
            inside = F.when(F.element_at(array(alone), at), by_hash).otherwise((value - F.element_at(array(lows), at)) / F.element_at(array(spans), at))
            at = F.element_at(array(before), at) + share(inside, F.element_at(array(parts), at)) + 1
        bucket = F.when(F.col("doc_id").isNull(), bucket).otherwise(at - 1)
    bucket = bucket.cast("long")
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", "text_hash")
    first = docs.select(bucket.alias("b"), order.alias("k")).groupBy("b").agg(F.min("k").alias("k"))
    rows = sorted((r["b"], r["k"]["doc_id"], r["k"]["text_hash"]) for r in first.collect())  # a few numbers for each bucket
    edges = [(i, h, rows[n - 1][0]) for n, (_, i, h) in enumerate(rows)]
    table = docs.sparkSession.createDataFrame(edges, "first_id long, first_hash long, before long")
    return bucket, F.broadcast(table) if len(edges) <= MOST_EDGES else table


def with_next(docs: DataFrame, more: Callable[[Column], list[Column]]) -> DataFrame:
    """(doc_id, body, text_hash, *more, next_*): each row and the next in order of (doc_id, text hash), after the last the first.

    Rows are dealt by bucket of the id, and of the text's hash where many rows have one id;
    the first document of a bucket is also put at the end of the bucket before.
    """
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("body")).withColumn("text_hash", F.xxhash64("body"))
    bucket, edges = _buckets(hashed)
    rows = hashed.select("doc_id", "body", "text_hash", *more(F.col("body")))
    names = rows.columns
    places = F.filter(F.array(F.struct(bucket.alias("b"), F.lit(0).alias("extra")), F.struct(F.col("before").alias("b"), F.lit(1).alias("extra"))), lambda p: p["b"].isNotNull())
    at_edge = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    dealt = rows.join(edges, at_edge, "left").select(*names, F.explode(places).alias("at")).select(*names, "at.b", "at.extra")
    order = Window.partitionBy("b").orderBy("extra", F.col("doc_id").asc_nulls_first(), "text_hash")
    return dealt.select(*names, "extra", *[F.lead(c).over(order).alias(f"next_{c}") for c in names]).filter("extra = 0").drop("extra")


def edited(rows: DataFrame) -> Column:
    """The text with its last half replaced by as many (or all) first code points of the next one."""
    n = F.length("body")
    half = F.shiftright(n, 1)
    return F.concat(F.substring("body", F.lit(1), n - half), F.substring("next_body", F.lit(1), half))


def fingerprint_documents(docs: DataFrame, hashed: Callable[[Column], Column] = wide_hash) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty. Rows are ordered by doc_id, null ids first, rows of one id by their
    text's hash; a single row is its own next. Repeated rows each give a row. An empty table
    gives no rows; further columns of ``docs`` are ignored.
    """
    pairs = with_next(docs, lambda body: [hashed(canonical(body)).alias("hash")])
    rows = pairs.withColumn("edited", edited(pairs)).withColumn("edited_canonical", canonical(F.col("edited"))).withColumn("edited_hash", hashed(F.col("edited_canonical")))
    same = lambda hashes, texts: F.when(hashes, F.when(texts, 1.0).otherwise(0.0)).otherwise(0.0)  # noqa: E731  bytes only where hashes agree
    keys = written(
        rows.select(
            "doc_id", "text_hash", "next_doc_id", "next_text_hash", F.length("body").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "hash", "edited_hash",
            same(F.col("hash") == F.col("edited_hash"), canonical(F.col("body")) == F.col("edited_canonical")).alias("near_edited"),
            same(F.col("hash") == F.col("next_hash"), canonical(F.col("body")) == canonical(F.col("next_body"))).alias("near_next"),
        ),
        "fingerprint_keys",
    )
    entry = lambda which, h: F.struct(F.lit(which).alias("which"), F.col(h).alias("h"))
    entries = keys.select("doc_id", "text_hash", "next_doc_id", "next_text_hash", F.explode(F.array(entry(0, "hash"), entry(1, "edited_hash"))).alias("e")).select("*", "e.which", "e.h").drop("e")
    shared = written(entries.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "fingerprint_buckets")
    forms = _forms(docs, entries.join(shared, "h"))
    collided = written(forms.groupBy("h", "form").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "fingerprint_collisions")
    if collided.isEmpty():
        out = keys.withColumn("fingerprint", F.col("hash")).withColumn("edited_fingerprint", F.col("edited_hash"))
    else:
        apart = forms.join(collided, "h")
        rank = apart.select("h", "form").distinct().withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("form")))
        named = apart.join(rank, ["h", "form"]).select("doc_id", "text_hash", "next_doc_id", "next_text_hash", "which", F.concat_ws("-", "h", "k").alias("name")).distinct()
        out = keys
        for which, h, name in ((0, "hash", "fingerprint"), (1, "edited_hash", "edited_fingerprint")):
            n, ids = named.filter(F.col("which") == which).alias("n"), ("doc_id", "text_hash", "next_doc_id", "next_text_hash")
            on = F.lit(True)
            for c in ids:
                on = on & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
            out = out.alias("o").join(n, on, "left").select("o.*", F.coalesce("n.name", f"o.{h}").alias(name))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _forms(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """``entries`` with the canonical form of their text; texts are fetched only for these."""
    own = F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("th"), F.lit(0).alias("role"))
    following = F.struct(F.col("next_doc_id").alias("id"), F.col("next_text_hash").alias("th"), F.lit(1).alias("role"))
    asked = entries.distinct().select("*", F.explode(F.when(F.col("which") == 0, F.array(own)).otherwise(F.array(own, following))).alias("r"))
    texts = docs.select(F.col("doc_id").alias("id"), text_of().alias("text")).withColumn("th", F.xxhash64("text")).alias("t")
    met = asked.alias("a").join(texts, F.col("a.r.id").eqNullSafe(F.col("t.id")) & (F.col("a.r.th") == F.col("t.th")))
    whole = met.groupBy("h", "which", "doc_id", "text_hash", "next_doc_id", "next_text_hash").agg(
        F.max(F.when(F.col("r.role") == 0, F.col("t.text"))).alias("body"), F.max(F.when(F.col("r.role") == 1, F.col("t.text"))).alias("next_body")
    )
    return whole.withColumn("form", canonical(F.when(F.col("which") == 0, F.col("body")).otherwise(edited(whole)))).drop("body", "next_body")
