"""Adoption and impact over time: the monthly report and three period reports that differ in what they count."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclelens.domain import Domain
from cyclelens.functions.scalars import (
    days_between,
    instant,
    month_start,
    month_text,
    percent,
)
from cyclelens.operators.facts import issue_fact
from cyclelens.operators.periods import first_day, in_period, period_calendar, period_table
from cyclelens.operators.ranking import nest_ranked, top_k
from cyclelens.operators.summarize import coarser, summary_of, tally
from cyclelens.plans.rollups import category_shares
from cyclelens.sources.storage import TableStore

PERIOD = ("total_issues", "ai_assisted_issues", "non_ai_assisted_issues")
PERIOD_AVERAGES = (
    "avg_cycle_time_with_ai",
    "avg_cycle_time_without_ai",
    "cycle_time_impact_percentage",
    "ai_adoption_percentage",
)


def timeline_adoption(domain: Domain) -> DataFrame:
    """Commits by commit month beside issues by resolution month; average cycle time is a whole number of days."""
    monthly = domain.commits.groupBy(month_start("commit_date").alias("m")).agg(
        F.count(F.lit(1)).alias("total_commits"), F.count_if("ai_used").alias("ai_commits")
    )
    resolved = issue_fact(domain).groupBy(month_start("resolution_date").alias("m")).agg(
        F.count(F.lit(1)).alias("resolved_issues"), F.sum("cycle_time").alias("total_cycle_time")
    )
    return (
        monthly.join(resolved, "m", "left")
        .select(
            month_text("m").alias("month"),
            "total_commits",
            "ai_commits",
            F.coalesce("resolved_issues", F.lit(0)).alias("resolved_issues"),
            F.coalesce(F.expr("total_cycle_time div resolved_issues"), F.lit(0)).alias("avg_cycle_time"),
            percent("ai_commits", "total_commits").alias("ai_adoption_rate"),
        )
        .orderBy("month")
    )


class Periods:
    """The periods of one report and the commits that fall in them."""

    def __init__(self, domain: Domain, end: date, start: date | None = None, interval: str = "month"):
        self.domain, self.interval = domain, interval
        self.start = start or first_day(domain.commits) or end
        self.end = end
        self.table = period_table(domain.spark, self.start, end, interval).withColumnRenamed("period_start", "time_period")
        self.days = period_calendar(domain.spark, self.start, end, interval).withColumnRenamed("period_start", "time_period")

    def commits(self) -> DataFrame:
        return in_period(self.domain.commits, "commit_date", self.days)

    def rolled(self) -> DataFrame:
        """(issue, period): commits of the issue within the period."""
        return self.commits().groupBy(F.col("jira_issue_id").alias("issue_id"), "time_period").agg(
            F.min("commit_date").alias("first_commit_date"),
            F.count(F.lit(1)).alias("total_commits"),
            (F.count_if("ai_used") > 0).alias("has_ai_commits"),
        )

    def resolved_in_period(self) -> DataFrame:
        """Issues resolved in the period in which they also have commits, measured on those commits."""
        issues = in_period(self.domain.resolved.select("issue_id", "resolution_date", "category"), "resolution_date", self.days)
        return issues.join(self.rolled(), ["issue_id", "time_period"]).withColumn(
            "cycle_time", days_between("first_commit_date", "resolution_date")
        )

    def filled(self, summary: DataFrame) -> DataFrame:
        """The summary for every period, zeros for the empty ones."""
        joined = self.table.select("time_period").join(summary, "time_period", "left")
        return joined.fillna(0, list(PERIOD)).fillna(0.0, list(PERIOD_AVERAGES)).select("time_period", *PERIOD, *PERIOD_AVERAGES)


def _by_period(fact: DataFrame, value: str) -> DataFrame:
    """Counts and averages per period; an average without issues is NULL."""
    ai, no_ai = F.col("has_ai_commits"), ~F.col("has_ai_commits")
    return fact.groupBy("time_period").agg(
        F.count(F.lit(1)).alias("total_issues"),
        F.count_if(ai).alias("ai_assisted_issues"),
        F.count_if(no_ai).alias("non_ai_assisted_issues"),
        F.avg(F.when(ai, F.col(value))).alias("avg_cycle_time_with_ai"),
        F.avg(F.when(no_ai, F.col(value))).alias("avg_cycle_time_without_ai"),
    )


def _resolved_rows(periods: Periods, tallied: DataFrame) -> DataFrame:
    summary = summary_of(tallied).select(
        "time_period",
        "total_issues",
        F.col("issues_with_ai").alias("ai_assisted_issues"),
        F.col("issues_without_ai").alias("non_ai_assisted_issues"),
        *PERIOD_AVERAGES[:3],
        percent("issues_with_ai", "total_issues").alias("ai_adoption_percentage"),
    )
    return periods.filled(summary)


def timeline_periods(domain: Domain, end: date, start: date | None = None, interval: str = "month") -> DataFrame:
    """Issues resolved in a period, seen through that period's commits; a row for every period."""
    periods = Periods(domain, end, start, interval)
    return _resolved_rows(periods, tally(periods.resolved_in_period(), "time_period"))


def timeline_top_categories(
    domain: Domain, end: date, start: date | None = None, interval: str = "month", k: int = 5
) -> DataFrame:
    """The k most frequent categories of each period with their AI share."""
    fact = Periods(domain, end, start, interval).resolved_in_period()
    return category_shares(tally(fact, "time_period", "category"), "time_period", k)


def _busiest(periods: Periods, k: int) -> DataFrame:
    counted = periods.commits().groupBy("time_period", "repo_id").agg(
        F.count(F.lit(1)).alias("commit_count"), F.count_if("ai_used").alias("ai_commits")
    )
    return top_k(counted, "time_period", "commit_count", "repo_id", k).select(
        "time_period", "rank", "repo_id", "commit_count", percent("ai_commits", "commit_count").alias("ai_percentage")
    )


def top_repositories(
    domain: Domain, end: date, start: date | None = None, interval: str = "month", k: int = 5
) -> DataFrame:
    """The k repositories with most commits in each period, with their AI share."""
    return _busiest(Periods(domain, end, start, interval), k)


def timeline_commit_volume(domain: Domain, end: date, start: date | None = None, interval: str = "month") -> DataFrame:
    """All issues in every period; the cycle time columns hold average commits per issue, and impact is with / without - 1."""
    periods = Periods(domain, end, start, interval)
    all_issues = domain.jira_issues.agg(F.count(F.lit(1)).alias("n")).scalar()
    w, wo = F.col("avg_cycle_time_with_ai"), F.col("avg_cycle_time_without_ai")
    summary = _by_period(periods.rolled(), "total_commits").withColumn(
        "cycle_time_impact_percentage", (F.try_divide(w, wo) - 1) * 100
    )
    joined = periods.table.select("time_period").join(summary, "time_period", "left")
    return (
        joined.withColumn("total_issues", all_issues)
        .withColumn("ai_adoption_percentage", percent("ai_assisted_issues", "total_issues"))
        .fillna(0, list(PERIOD))
        .fillna(0.0, list(PERIOD_AVERAGES))
        .select("time_period", *PERIOD, *PERIOD_AVERAGES)
    )


def timeline_creation_to_resolution(
    domain: Domain,
    end: date,
    start: date | None = None,
    interval: str = "month",
    last_stored: date | None = None,
) -> DataFrame:
    """Issues with a commit in the period, timed from creation to resolution; unresolved ones are counted, not timed.

    With `last_stored` (the newest stored period), only that period and later ones are computed.
    """
    periods = Periods(domain, end, last_stored or start, interval)
    issues = domain.jira_issues.select("issue_id", days_between("creation_date", "resolution_date").alias("days"))
    summary = _by_period(periods.rolled().join(issues, "issue_id"), "days")
    w, wo = F.col("avg_cycle_time_with_ai"), F.col("avg_cycle_time_without_ai")
    summary = summary.withColumns(
        {
            "cycle_time_impact_percentage": F.when(wo > 0, F.try_divide(wo - w, wo) * 100).otherwise(F.lit(0.0)),
            "ai_adoption_percentage": percent("ai_assisted_issues", "total_issues"),
        }
    )
    return periods.filled(summary)


def timeline_materialized(
    domain: Domain, store: TableStore, as_of: datetime, end: date, start: date | None = None, interval: str = "month"
) -> DataFrame:
    """The stored period row: summary, period bounds and the nested top categories and repositories (at most five).

    Summary and categories come from one written tally by (period, category), so the issues are measured once.
    """
    periods = Periods(domain, end, start, interval)
    by_category = tally(periods.resolved_in_period(), "time_period", "category")
    tallied = store.replace("timeline_categories", by_category)
    category = F.struct("category", F.col("issue_count").alias("count"), F.col("ai_percentage").alias("aiPercentage"))
    repository = F.struct(
        F.col("repo_id").alias("repoId"),
        F.col("commit_count").alias("commitCount"),
        F.col("ai_percentage").alias("aiPercentage"),
    )
    categories = nest_ranked(category_shares(tallied, "time_period"), "time_period", "top_categories", category)
    repositories = nest_ranked(_busiest(periods, 5), "time_period", "top_repositories", repository)
    return (
        _resolved_rows(periods, coarser(tallied, "time_period"))
        .join(periods.table, "time_period")
        .join(categories, "time_period", "left")
        .join(repositories, "time_period", "left")
        .withColumn("interval", F.lit(interval))
        .withColumn("last_calculated", instant(as_of))
    )


def timeline_read(
    stored: DataFrame, as_of: date, start: date | None = None, end: date | None = None, interval: str = "month"
) -> DataFrame:
    """Stored periods of an interval in a range, in order; an open range reaches from 1900 to `as_of`."""
    chosen = stored.where((F.col("interval") == interval) & F.col("time_period").between(start or date(1900, 1, 1), end or as_of))
    return chosen.orderBy("time_period")


def timeline_document(rows: DataFrame, interval: str = "month") -> DataFrame:
    """The periods as one ordered document; its length is the number of periods, which the date type bounds."""
    fields = F.struct("time_period", *PERIOD, *PERIOD_AVERAGES)
    return rows.agg(F.array_sort(F.collect_list(fields)).alias("data")).select(F.lit(interval).alias("interval"), "data")


def timeline_current(
    domain: Domain,
    store: TableStore,
    as_of: datetime,
    start: date | None = None,
    end: date | None = None,
    interval: str = "month",
    max_age_hours: int = 24,
    force: bool = False,
) -> DataFrame:
    """Stored periods of an interval in a range, all of them computed and merged in first if none in the range is fresh.

    Intervals share the table, so its key is the interval and the period.
    """
    name, today = "timeline_metrics_materialized", as_of.date()
    fresh = F.col("last_calculated") >= instant(as_of - timedelta(hours=max_age_hours))
    known = store.exists(name) and not force
    if not known or timeline_read(store.read(name), today, start, end, interval).where(fresh).isEmpty():
        rows = timeline_materialized(domain, store, as_of, end or today, start, interval)
        store.upsert(name, rows, ("interval", "time_period"))
    return timeline_read(store.read(name), today, start, end, interval)
