"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlake.llm import bpe, exact_dedup, fingerprints, lang_id, line_dedup, packing, pii, simhash, toxicity, warc
from flightlake.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    runs = F.array_join(F.transform("keep_bitmap", lambda r: F.concat_ws(":", r["start"].cast("string"), r["length"].cast("string"))), ",")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"), runs.alias("keep_bitmap"))


def op2_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_line_dedup, op2_lang_id, op3_fingerprints, op4_packing, op5_simhash, op6_pii, op7_exact_dedup, op8_bpe, op9_toxicity, op10_warc)
    return {f.__name__: f for f in every}


_WS = r"[\x20\x09-\x0D]"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op1_line_dedup": rf"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
            FROM documents
        ), k AS (
            SELECT doc_id, pos, line, {_LOWER.format(f"regexp_replace(regexp_replace(line, '^{_WS}+', ''), '{_WS}+$', '')")} AS key FROM l
        ), c AS (
            SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        )
        , f AS (SELECT k.doc_id, k.pos, k.line, c.key IS NULL OR k.doc_id = c.last_doc AS kept FROM k LEFT JOIN c ON k.key = c.key),
        r AS (SELECT doc_id, min(pos) AS a, count(*) AS n FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f WHERE kept) GROUP BY doc_id, run),
        b AS (SELECT doc_id, string_agg(a || ':' || n, ',' ORDER BY a) AS runs FROM r GROUP BY doc_id)
        SELECT f.doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE NOT kept))::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE kept), '')) AS kept_sha256, coalesce(any_value(b.runs), '') AS keep_bitmap
        FROM f LEFT JOIN b ON b.doc_id = f.doc_id GROUP BY f.doc_id
    """,
    "op7_exact_dedup": rf"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{_WS}', '', 'g') AS body FROM documents
        ), g AS (
            SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY body) AS group_size FROM n
        )
        SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        h AS (SELECT page_id, strlen(html)::BIGINT AS n, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
        d AS (
            SELECT page_id, list_aggregate(list_transform(range(0, 32), lambda i: substr(
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS digest FROM h
        )
        SELECT h.page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first = h.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> h.page_id THEN first END AS refers_to
        FROM h JOIN d USING (page_id)
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
