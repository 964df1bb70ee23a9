"""The corpus pipeline: documents to packed sequences, one written table per stage.

Every stage handles null texts and ids, repeated rows, empty tables and further columns as
the operator it calls says. What a stage decided stays beside its table in the shared
folder: ``languages-*`` (prediction and score of every row), ``exact_classes-*`` and
``near_classes-*`` (who went for whom).
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flightlake.llm import exact_dedup, lang_id, packing, pii, simhash
from flightlake.llm.common import shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language stay; without letters, as null texts are, they go, and so do long ones unlike all that was learned."""
    return lang_id.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the longest, then the least id; null texts are empty."""
    return exact_dedup.keep_unique(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, the least id; rows of one id with different texts are judged apart."""
    return simhash.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced; every row stays, a null text as it is."""
    return pii.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become pieces of sequences, one at least for every row; a null text is empty."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", packed)]
#: Profiles, fingerprints and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_dir(spark)}/flightlake/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{home}/{k}-{name}")
            docs = spark.read.parquet(f"{home}/{k}-{name}")
    return docs
