"""Loading a folder of CSV files, and looking at tables: samples, counts, single metric rows."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclelens import schemas
from cyclelens.domain import Domain
from cyclelens.sources.csv import Ingested, ingest

log = logging.getLogger(__name__)


def seed_all(spark: SparkSession, folder: str, mode: str = "strict") -> dict[str, Ingested]:
    """All tables that have a file `<table>.csv`, in reference order; a missing file is skipped with a warning."""
    loaded: dict[str, Ingested] = {}
    for table in schemas.TABLES:
        try:
            loaded[table] = ingest(spark, f"{folder.rstrip('/')}/{table}.csv", table, mode)
        except FileNotFoundError:
            log.warning("File %s.csv not found. Skipping.", table)
    return loaded


def table_sample(domain: Domain, table: str, limit: int = 5) -> DataFrame:
    """The first rows by primary key; the sort keeps `limit` rows per task and never orders the whole table."""
    if not isinstance(limit, int) or limit <= 0:
        raise ValueError("Limit must be a positive number")
    return domain.table(table).orderBy(*schemas.PRIMARY_KEYS[table]).limit(limit)


def table_counts(domain: Domain) -> DataFrame:
    """(table_name, n) of every base table."""
    counts = [
        domain.table(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n") for t in schemas.TABLES
    ]
    return reduce(DataFrame.unionByName, counts)


def entity_keys(domain: Domain) -> DataFrame:
    """(dimension, entity_key) of everything that owns metrics."""

    def keys(df: DataFrame, dimension: str, column: str) -> DataFrame:
        return df.select(F.lit(dimension).alias("dimension"), F.col(column).cast("string").alias("entity_key")).distinct()

    return (
        keys(domain.teams, "team", "team_id")
        .unionByName(keys(domain.commits, "engineer", "engineer_id"))
        .unionByName(keys(domain.jira_issues, "author", "author_id"))
        .unionByName(keys(domain.jira_issues, "project", "project_id"))
        .unionByName(keys(domain.jira_issues, "category", "category"))
    )


def distinct_entity_counts(domain: Domain) -> DataFrame:
    """(dimension, n): exact distinct counts; the distinct keys are found next to the scan, so few rows move."""

    def named(df: DataFrame, dimension: str, column: str) -> DataFrame:
        return df.agg(F.countDistinct(column).alias("n")).select(F.lit(dimension).alias("dimension"), "n")

    return (
        named(domain.commits, "engineer", "engineer_id")
        .unionByName(named(domain.jira_issues, "author", "author_id"))
        .unionByName(named(domain.jira_issues, "category", "category"))
    )


def issue_counts(domain: Domain) -> DataFrame:
    """(dimension, entity_key, n): resolved issues per category and issues per author."""
    n = F.count(F.lit(1)).alias("n")
    category = domain.resolved.groupBy(F.col("category").alias("entity_key")).agg(n)
    author = domain.jira_issues.groupBy("author_id").agg(n).withColumnRenamed("author_id", "entity_key")
    return category.select(F.lit("category").alias("dimension"), "entity_key", "n").unionByName(
        author.select(F.lit("author").alias("dimension"), F.col("entity_key").cast("string").alias("entity_key"), "n")
    )


def metrics_lookup(stored: DataFrame, key: str, value: int | str) -> DataFrame:
    """The stored row of one entity, read with the key as a pushed-down filter."""
    if isinstance(value, int) and value <= 0:
        raise ValueError(f"{key} must be a positive number")
    return stored.where(F.col(key) == F.lit(value))
