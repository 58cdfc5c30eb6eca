"""What a task reads stays small enough to be sorted and grouped without spilling, and what is stored is not made twice."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cyclelens import catalog
from cyclelens.plans import high_water, stored_facts
from cyclelens.session import adapt, work_dir
from cyclelens.sources.buckets import BucketStore
from cyclelens.sources.load_set import LoadSets
from tests.conftest import SF, as_set

ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@pytest.fixture
def unset(spark):
    before = spark.conf.get(ADVISORY, None)
    spark.conf.unset(ADVISORY)
    yield
    spark.conf.unset(ADVISORY)
    if before is not None:
        spark.conf.set(ADVISORY, before)


def test_partitions_are_not_coalesced_to_large_tasks(spark, unset):
    first = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    adapt(spark)
    spark.conf.set(first, "false")
    try:
        # About 40 MB shuffled, which no compression makes less: one task of 64 MB by Spark's own size.
        rows = spark.range(0, 2_500_000, 1, 2).select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"))
        assert rows.repartition("a").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset(first)


def test_a_size_of_the_sessions_own_stays(spark, unset):
    spark.conf.set(ADVISORY, "1m")
    assert adapt(spark).conf.get(ADVISORY) == "1m"


@pytest.mark.parametrize("late", [True, False])
def test_postings_follow_the_summary(spark, small, late):
    """Where most buckets are touched they are made from the summary, else by key; the rows are the same."""
    as_of = datetime(2024, 3, 1)
    kept = high_water.ImpactTables(BucketStore(spark, f"{work_dir(spark, 'postings')}/store", bucket_rows=1))
    kept.rebuild(small.having(commits=small.commits.where(F.col("commit_date") <= F.lit(date(2024, 1, 5)))), as_of)
    assert not kept.store.exists(f"{high_water.POSTINGS}_staged")
    kept.store.touches_most = lambda *_: late
    folder = f"{work_dir(spark, 'postings')}/commits"
    small.commits.withColumn("commit_month", F.date_format("commit_date", "yyyyMM").cast("int")).write.partitionBy("commit_month").parquet(folder)
    kept.advance(small, folder, as_of)
    assert kept.store.exists(f"{high_water.POSTINGS}_delta") is not late
    whole = stored_facts.ai_impact_summary(small, as_of)
    assert as_set(kept.store.read(high_water.POSTINGS).select("team_id", *whole.columns)) == as_set(high_water.posted(whole))


def test_most_buckets(spark):
    store = BucketStore(spark, work_dir(spark, "most"), bucket_rows=10)
    store.deal("t", spark.range(200).select(F.col("id").alias("k")), "k")
    assert store.touches_most("t", spark.range(200).select(F.col("id").alias("k")))
    assert not store.touches_most("t", spark.range(3).select(F.col("id").alias("k")))


def test_the_second_load_reads_the_stored_commits(spark, monkeypatch):
    given, load = [], LoadSets.load
    monkeypatch.setattr(LoadSets, "load", lambda self, tables: (given.append(tables["commits"]), load(self, tables))[1])
    catalog.QUERIES["load_set_refused"](spark, SF).collect()
    assert all("/sets/v0000000001/commits" in f for f in given[1].inputFiles())
