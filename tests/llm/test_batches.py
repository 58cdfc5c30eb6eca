"""Whole texts reach packing in batches of bounded bytes, whatever their number."""

import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from cyclelens.llm import packing
from cyclelens.llm.common import mapped

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
PATH = public_tokenizers.path("word_bpe_49k.json")


def measured(monkeypatch, docs):
    """(rows, bytes) of each batch that pieces_of reads."""

    def sizes(batches):
        for batch in batches:
            made = [pa.array([n], pa.int64()) for n in (0, batch.num_rows, batch.nbytes, 0)]
            yield pa.RecordBatch.from_arrays([*made, pa.array([[]], pa.list_(pa.int64())), pa.array([0], pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "part_crcs", "doc_tokens"])

    monkeypatch.setattr(packing, "mapped", lambda df, function, schema: mapped(df, sizes, schema))
    return [(r["start"], r["length"]) for r in packing.pieces_of(docs, PATH).collect()]


def test_batches_of_long_texts(spark, monkeypatch):
    """40 texts of half a MB and one of 9 MB, in one task: but for the one with the longest text, no batch passes the limit by more than a text."""
    size = F.when(F.col("id") == 20, 9_000_000).otherwise(500_000).cast("int")
    docs = spark.range(0, 41, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), size).alias("text"))
    found = measured(monkeypatch, docs)
    assert sum(rows for rows, _ in found) == 41 and sum(n for _, n in found) >= 29_000_000
    assert sorted(n for _, n in found)[-2] < (4 << 20) + 600_000
    assert spark.conf.get(LIMIT, None) is None


def test_a_limit_of_the_sessions_own_stays(spark, monkeypatch):
    docs = spark.range(0, 10, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100_000).alias("text"))
    spark.conf.set(LIMIT, "250000")
    try:
        assert len(measured(monkeypatch, docs)) > 2
        assert spark.conf.get(LIMIT) == "250000"
    finally:
        spark.conf.unset(LIMIT)


def test_pieces_do_not_depend_on_batches(spark):
    docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.lit(0), F.col("id") * 20)).alias("text"))
    rows = sorted(map(tuple, packing.pieces_of(docs, PATH).collect()))
    spark.conf.set(LIMIT, "10000")
    try:
        assert sorted(map(tuple, packing.pieces_of(docs, PATH).collect())) == rows
    finally:
        spark.conf.unset(LIMIT)
