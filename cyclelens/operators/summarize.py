"""The summary every rollup shares, for any grouping of an issue fact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclelens.functions.scalars import impact_percent

COUNTS = ("total_issues", "issues_with_ai", "issues_without_ai")
AVERAGES = (
    "avg_cycle_time_with_ai",
    "avg_cycle_time_without_ai",
    "cycle_time_impact_percentage",
    "avg_commits_with_ai",
    "avg_commits_without_ai",
)
SUMMARY = COUNTS + AVERAGES


TALLY = ("issues_with_ai", "issues_without_ai", "days_with_ai", "days_without_ai", "commits_with_ai", "commits_without_ai")


def tally(fact: DataFrame, *keys: str | Column, also: Sequence[Column] = ()) -> DataFrame:
    """Issue counts and sums of days and commits per key and AI group; tallies of finer keys add up to coarser ones. `also` are further aggregates.

    Rows without an AI flag (issues that cannot be analysed) count for nothing but give their key a row.
    Every aggregate has a fixed-size buffer and is combined before the shuffle, so the shuffle moves at most one row
    per key and task however many issues a key has.
    """
    ai, no_ai = F.col("has_ai_commits"), ~F.col("has_ai_commits")
    return fact.groupBy(*keys).agg(
        F.count_if(ai).alias("issues_with_ai"),
        F.count_if(no_ai).alias("issues_without_ai"),
        F.sum(F.when(ai, F.col("cycle_time"))).alias("days_with_ai"),
        F.sum(F.when(no_ai, F.col("cycle_time"))).alias("days_without_ai"),
        F.sum(F.when(ai, F.col("total_commits"))).alias("commits_with_ai"),
        F.sum(F.when(no_ai, F.col("total_commits"))).alias("commits_without_ai"),
        *also,
    )


def coarser(tallied: DataFrame, *keys: str) -> DataFrame:
    return tallied.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in TALLY])


def _average(total: str, count: str) -> Column:
    return F.coalesce(F.try_divide(F.col(total).cast("double"), F.col(count).cast("double")), F.lit(0.0))


def summary_of(tallied: DataFrame) -> DataFrame:
    """Counts, averages and impact from a tally."""
    with_ai = _average("days_with_ai", "issues_with_ai")
    without_ai = _average("days_without_ai", "issues_without_ai")
    return tallied.select(
        *[c for c in tallied.columns if c not in TALLY],
        (F.col("issues_with_ai") + F.col("issues_without_ai")).alias("total_issues"),
        "issues_with_ai",
        "issues_without_ai",
        with_ai.alias("avg_cycle_time_with_ai"),
        without_ai.alias("avg_cycle_time_without_ai"),
        impact_percent(with_ai, without_ai).alias("cycle_time_impact_percentage"),
        _average("commits_with_ai", "issues_with_ai").alias("avg_commits_with_ai"),
        _average("commits_without_ai", "issues_without_ai").alias("avg_commits_without_ai"),
    )


def summarize(fact: DataFrame, *keys: str | Column) -> DataFrame:
    """The summary per key; without keys, one row even for an empty fact."""
    return summary_of(tally(fact, *keys))


def for_every(entities: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """The summary with a row of zeros for each entity that has nothing to summarize."""
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS]
    averages = [F.coalesce(c, F.lit(0.0)).alias(c) for c in AVERAGES]
    return entities.join(summary, key, "left").select(*entities.columns, *counts, *averages)


def summary_struct() -> Column:
    """The summary columns as the nested document readers of the dashboard expect."""
    return F.struct(
        F.col("total_issues").alias("totalIssuesAnalyzed"),
        F.col("issues_with_ai").alias("issuesWithAi"),
        F.col("issues_without_ai").alias("issuesWithoutAi"),
        F.col("avg_cycle_time_with_ai").alias("avgCycleTimeWithAi"),
        F.col("avg_cycle_time_without_ai").alias("avgCycleTimeWithoutAi"),
        F.col("cycle_time_impact_percentage").alias("cycleTimeImpactPercentage"),
        F.col("avg_commits_with_ai").alias("avgCommitsWithAi"),
        F.col("avg_commits_without_ai").alias("avgCommitsWithoutAi"),
    )
