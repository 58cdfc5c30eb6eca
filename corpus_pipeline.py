"""From raw documents to packed training sequences: the training-data operators as stages, each written and read again.

A stage works on all that its predecessor kept. All but the last return the columns of `documents`; a document with a null id is never
dropped by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclelens.llm.common import table, written
from cyclelens.llm.exact_dedup import deduplicated
from cyclelens.llm.near_dedup import one_of_each
from cyclelens.llm.packing import packed
from cyclelens.llm.quality import good_ones
from cyclelens.llm.secrets import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are far likelier as raw than as good text go."""
    return good_ones(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs)


def scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; n_chars follows the text where it was known."""
    out = redacted(docs)
    if "n_chars" not in out.columns:
        return out
    length = F.when(F.col("n_chars").isNotNull(), F.length("text").cast(out.schema["n_chars"].dataType))
    return out.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces in sequences of at most 4,096 tokens."""
    import public_tokenizers

    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("secret scan", scan), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs


#: The quality model's sampling and the tokenizer's ids have no SQL form; tests/llm/test_pipeline.py compares run() with plain Python.
ORACLE_SQL = None
