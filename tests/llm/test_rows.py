"""Stages of the pipeline decide on rows, also where an id repeats."""

import random

from pyspark.sql import functions as F

from cyclelens.llm import exact_dedup, near_dedup, quality
from tests.conftest import SF
from tests.llm.cases import documents, words

RNG = random.Random(6)
A, B, C, D = (words(RNG, 80) for _ in range(4))
NEAR = " ".join([*A.split()[:79], "changed"])


def left(docs):
    return sorted((r.doc_id, r.text) for r in docs.collect())


def test_an_unrelated_row_of_a_copys_id_stays(spark):
    rows = [(1, A), (2, A), (2, B), (3, C), (3, C), (4, D), (2, A.replace(" ", "  ", 1))]
    docs = documents(spark, rows)
    out = exact_dedup.deduplicated(docs)
    assert out.columns == docs.columns and left(out) == sorted([(1, A), (2, B), (3, C), (4, D)])


def test_an_unrelated_row_of_a_near_copys_id_stays(spark):
    docs = documents(spark, [(1, A), (2, NEAR), (2, B), (3, C), (3, C), (4, D)])
    out = near_dedup.one_of_each(docs)
    assert out.columns == docs.columns and left(out) == sorted([(1, A), (2, B), (3, C), (4, D)])


def test_a_clean_row_of_a_junk_rows_id_stays(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.resampled(docs, labels).join(docs.select("doc_id", "text"), "doc_id")
    junk = scored.where("not kept").orderBy("log_weight").first().text
    clean = scored.where("kept").orderBy(F.col("log_weight").desc()).first().text
    shared = docs.select("doc_id", "text").union(spark.createDataFrame([(10**9, junk), (10**9, clean)], "doc_id long, text string"))
    assert [r.text for r in quality.good_ones(shared, labels).where(f"doc_id = {10**9}").collect()] == [clean]
