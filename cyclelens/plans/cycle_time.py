"""Cycle time per issue and its distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclelens.domain import Domain
from cyclelens.functions.scalars import clamped_days, days_between
from cyclelens.operators.facts import commit_rollup

UNRESOLVED = "Issue not found or has not been resolved"
NO_COMMITS = "No commits found for this issue"


def issue_cycle_time(domain: Domain, issue: int | None = None) -> DataFrame:
    """Clamped cycle time and commit counts per issue, or the reason why there is none."""
    issues, commits = domain.jira_issues, domain.commits
    if issue is not None:
        issues = issues.where(F.col("issue_id") == issue)
        commits = commits.where(F.col("jira_issue_id") == issue)
    joined = issues.select("issue_id", "resolution_date").join(commit_rollup(commits), "issue_id", "left")
    message = F.when(F.col("resolution_date").isNull(), UNRESOLVED).when(F.col("total_commits").isNull(), NO_COMMITS)
    known = message.isNull()

    def shown(value):
        return F.when(known, value)

    return joined.select(
        "issue_id",
        shown(clamped_days("first_commit_date", "resolution_date")).alias("cycle_time"),
        shown(F.col("first_commit_date")).alias("first_commit_date"),
        shown(F.col("resolution_date")).alias("resolution_date"),
        shown(F.col("total_commits")).alias("total_commits"),
        shown(F.col("ai_commits")).alias("ai_commits"),
        shown(F.col("total_commits") - F.col("ai_commits")).alias("non_ai_commits"),
        shown(F.try_divide(F.col("ai_commits").cast("double"), F.col("total_commits").cast("double"))).alias("ai_usage_ratio"),
        message.alias("message"),
    )


def all_issue_cycle_times(domain: Domain) -> DataFrame:
    """`issue_cycle_time` of every issue that has one; the joins are inner, as every other row would be dropped."""
    resolved = domain.having(jira_issues=domain.resolved)
    return issue_cycle_time(resolved).where(F.col("cycle_time").isNotNull()).drop("message")


def average_cycle_time(cycle_times: DataFrame) -> DataFrame:
    return cycle_times.agg(F.coalesce(F.avg("cycle_time"), F.lit(0.0)).alias("avg_cycle_time"))


def cycle_time_summary(domain: Domain) -> DataFrame:
    """Count, mean, median and range of cycle time by assistance type; unresolved issues are counted, not measured.

    Days are counted first, so the exact median is taken from a histogram of at most one row per type and day count,
    not from all issues.
    """
    rolled = domain.jira_issues.select("issue_id", "resolution_date").join(commit_rollup(domain.commits), "issue_id")
    assistance = F.when(F.col("ai_commits") > 0, "ai_assisted").otherwise("non_ai_assisted")
    days = days_between("first_commit_date", "resolution_date")
    histogram = rolled.groupBy(assistance.alias("assistance_type"), days.alias("days")).agg(F.count(F.lit(1)).alias("n"))
    measured = F.when(F.col("days").isNotNull(), F.col("n"))
    return histogram.groupBy("assistance_type").agg(
        F.sum("n").alias("issue_count"),
        F.try_divide(F.sum(F.col("days") * F.col("n")).cast("double"), F.sum(measured).cast("double")).alias(
            "avg_cycle_time_days"
        ),
        F.expr("percentile(days, 0.5, n)").alias("median_cycle_time_days"),
        F.min("days").alias("min_cycle_time_days"),
        F.max("days").alias("max_cycle_time_days"),
    )


def first_commit(domain: Domain) -> DataFrame:
    """The earliest commit of each issue, ties broken by commit id."""
    earliest = F.min(F.struct("commit_date", "commit_id"))
    return domain.commits.groupBy(F.col("jira_issue_id").alias("issue_id")).agg(earliest.alias("first")).select(
        "issue_id", F.col("first.commit_id").alias("commit_id"), F.col("first.commit_date").alias("commit_date")
    )
