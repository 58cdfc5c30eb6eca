"""AI impact over all or filtered issues, its categories and the issues behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclelens.domain import Domain
from cyclelens.operators.facts import issue_fact
from cyclelens.operators.summarize import summarize, summary_struct

DETAIL = ("issue_id", "cycle_time", "total_commits", "ai_commits", "non_ai_commits", "category")
# Issues per detail page; an issue id occurs once per entity, so a page cannot hold more.
PAGE_ISSUES = 1000
# Categories per document page, about: they are dealt to pages by a hash.
PAGE_CATEGORIES = 10_000


def ai_impact(
    domain: Domain,
    project: int | None = None,
    author: int | None = None,
    engineer: int | None = None,
    team: int | None = None,
) -> DataFrame:
    """The summary row; commit filters act before the rollup, issue filters on the issue. No match gives zeros."""
    return summarize(issue_fact(domain, project, author, engineer, team))


def category_stats(fact: DataFrame) -> DataFrame:
    """Issue count, total and average cycle time per category and AI flag."""
    return fact.groupBy("category", "has_ai_commits").agg(
        F.count(F.lit(1)).alias("issue_count"),
        F.sum("cycle_time").alias("total_cycle_time"),
        F.avg("cycle_time").alias("avg_cycle_time"),
    )


def issue_detail(fact: DataFrame, *keys: str) -> DataFrame:
    """The analysed issues of each entity and AI group, one row per issue.

    This keyed table stands for the issue lists of the summary documents: an entity may own any share of all issues,
    so they are never gathered into one value.
    """
    detail = [c for c in DETAIL if c not in keys]
    return fact.where(F.col("has_ai_commits").isNotNull()).select(*keys, "has_ai_commits", *detail)


def issue_detail_pages(fact: DataFrame, *keys: str) -> DataFrame:
    """Issue lists nested for document readers, in pages of at most PAGE_ISSUES neighbouring issue ids."""
    entry = F.struct(
        F.col("issue_id").alias("issueId"),
        F.col("cycle_time").alias("cycleTime"),
        F.col("total_commits").alias("totalCommits"),
        F.col("ai_commits").alias("aiCommits"),
        F.col("non_ai_commits").alias("nonAiCommits"),
        F.col("category").alias("category"),
    )
    paged = fact.where(F.col("has_ai_commits").isNotNull()).withColumn("page", F.expr(f"issue_id div {PAGE_ISSUES}"))
    return paged.groupBy(*keys, "has_ai_commits", "page").agg(F.array_sort(F.collect_list(entry)).alias("issues"))


def impact_document(fact: DataFrame) -> DataFrame:
    """The nested document of a computation: its summary and both maps from category to that category's figures.

    One row, or with more than PAGE_CATEGORIES categories one row per page of them, each with the whole summary. The issue lists
    are the pages of `issue_detail_pages`.
    """
    stats = category_stats(fact)
    pages = stats.select("category").distinct().count() // PAGE_CATEGORIES + 1
    entry = F.struct(
        F.col("category"),
        F.struct(
            F.col("issue_count").alias("count"),
            F.col("total_cycle_time").alias("totalCycleTime"),
            F.col("avg_cycle_time").alias("avgCycleTime"),
        ),
    )

    def categories(flag: Column, name: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(flag, entry)))).alias(name)

    ai = F.col("has_ai_commits")
    names = ("categoriesWithAi", "categoriesWithoutAi")
    sides = [categories(ai, names[0]), categories(~ai, names[1])]
    detailed = F.struct(*[F.col(name) for name in names]).alias("detailedStats")
    summary = summarize(fact).select(summary_struct().alias("summary"))
    if pages == 1:
        return stats.agg(*sides).select(summary.scalar().alias("summary"), detailed)
    paged = stats.groupBy(F.pmod(F.xxhash64("category"), F.lit(pages)).alias("page")).agg(*sides)
    return paged.select(summary.scalar().alias("summary"), detailed)


def impact_documents(summary: DataFrame, *keys: str) -> DataFrame:
    """(keys, document): the summary as nested JSON, for a sink that stores documents."""
    return summary.select(*keys, F.to_json(F.struct(summary_struct().alias("summary"))).alias("document"))
