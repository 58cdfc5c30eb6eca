"""Issue facts kept as tables: all teams, one team per engineer, the incremental refresh, and reads from the table."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclelens.domain import Domain
from cyclelens.functions.scalars import instant
from cyclelens.operators.facts import by_shifted_issue, by_team, contributions, engineer_rollup, lookup_join, measured, regroup
from cyclelens.operators.summarize import SUMMARY, summarize

FACT = (
    "issue_id",
    "project_id",
    "author_id",
    "category",
    "total_commits",
    "ai_commits",
    "non_ai_commits",
    "cycle_time",
    "has_ai_commits",
    "team_ids",
)
CARRIED = ("project_id", "author_id", "category")


def commit_teams_all(domain: Domain) -> DataFrame:
    """One row per commit and team of its engineer; commits of engineers without a team keep one row without team."""
    return lookup_join(domain.commits, domain.members, "engineer_id", "left", domain.members_are_few)


def first_teams(domain: Domain) -> DataFrame:
    """(engineer_id, team_id): the lowest team id of each engineer."""
    return domain.members.groupBy("engineer_id").agg(F.min("team_id").alias("team_id"))


def commit_teams_first(domain: Domain) -> DataFrame:
    """One row per commit with at most one team."""
    return lookup_join(
        domain.commits, first_teams(domain), "engineer_id", "left", domain.members_are_few
    )


def _with_teams(per_team: DataFrame, keep_null: bool) -> DataFrame:
    """Rows per (issue, team) folded to one row per issue with the sorted distinct teams.

    The array holds each team of the issue once, so its length is bounded by the number of teams, not of commits.
    """
    folded = per_team.groupBy("issue_id", "resolution_date", *CARRIED).agg(
        F.min("first_commit_date").alias("first_commit_date"),
        F.sum("total_commits").alias("total_commits"),
        F.sum("ai_commits").alias("ai_commits"),
        F.array_sort(F.collect_list("team_id")).alias("_teams"),
        F.count_if(F.col("team_id").isNull()).alias("_teamless"),
    )
    null_team = F.array(F.lit(None).cast("bigint"))
    if keep_null:
        teams = F.when(F.col("_teamless") > 0, F.concat("_teams", null_team)).otherwise(F.col("_teams"))
    else:
        teams = F.when(F.size("_teams") > 0, F.col("_teams"))
    return folded.select(
        "issue_id",
        "project_id",
        "author_id",
        "category",
        "total_commits",
        "ai_commits",
        (F.col("total_commits") - F.col("ai_commits")).alias("non_ai_commits"),
        F.datediff("resolution_date", "first_commit_date").alias("cycle_time"),
        (F.col("ai_commits") > 0).alias("has_ai_commits"),
        teams.alias("team_ids"),
    )


def ai_impact_base(domain: Domain, dedupe: bool = False) -> DataFrame:
    """Issue fact with all teams of all its engineers.

    A commit counts once per team of its engineer; with `dedupe`, only in the engineer's first team, hence once. Counts
    are taken per (issue, engineer) before the teams multiply them, so the fan-out never reaches the raw commits.
    """
    if dedupe:
        first = first_teams(domain).withColumnRenamed("team_id", "_first")
        members = domain.members.join(first, "engineer_id")
        spread = lookup_join(contributions(domain), members, "engineer_id", "left", domain.members_are_few)
        counts = F.col("team_id").eqNullSafe(F.col("_first"))
        spread = spread.withColumns({c: F.when(counts, F.col(c)).otherwise(0) for c in ("total_commits", "ai_commits")})
    else:
        spread = by_team(domain, contributions(domain), "left")
    return _with_teams(regroup(spread, "team_id", carry=CARRIED), keep_null=True)


def ai_impact_summary(domain: Domain, as_of: datetime, rolled: DataFrame | None = None, joined: DataFrame | None = None) -> DataFrame:
    """Issue fact with one team per engineer, so that commits are not multiplied. `joined` is the rollup beside its issues, if that was made."""
    if joined is None:
        shared = contributions(domain, rolled=rolled)
    else:
        # Asks for a count as well, so that it is not moved below the join, whose rows would then be others than those of further readers.
        shared = measured(joined.where(F.when(F.col("total_commits").isNotNull(), F.col("resolution_date")).isNotNull()))
    placed = lookup_join(shared, first_teams(domain), "engineer_id", "left", domain.members_are_few)
    return _with_teams(regroup(placed, "team_id", carry=CARRIED), keep_null=False).withColumn("last_updated", instant(as_of))


def changed_since(domain: Domain, mark: date) -> DataFrame:
    """Keys of issues with a commit after the mark."""
    newer = domain.commits.where(F.col("commit_date") > F.lit(mark))
    return newer.select(F.col("jira_issue_id").alias("issue_id")).distinct()


def summary_delta(domain: Domain, changed: DataFrame, as_of: datetime) -> DataFrame:
    """Summary rows of the changed issues, from all their commits and not only the new ones.

    The commits are rolled up next to the scan, so that the rollup and not the commits meets the changed keys.
    """
    keys = by_shifted_issue(changed).select("_issue")
    rolled = by_shifted_issue(engineer_rollup(domain)).join(keys, "_issue", "left_semi").drop("_issue")
    return ai_impact_summary(domain, as_of, rolled)


def ai_impact_incremental(domain: Domain, stored: DataFrame, mark: date, as_of: datetime) -> DataFrame:
    """The stored summary brought up to date for issues with commits after the mark; without a mark, made anew.

    Stored rows give way to the changed keys and not to the new rows: the keys come from the new commits alone, and an
    issue reopened in the meantime, which has no new row, goes as it would in a full run.
    """
    if mark is None:
        return ai_impact_summary(domain, as_of)
    changed = changed_since(domain, mark)
    return stored.join(changed, "issue_id", "left_anti").unionByName(summary_delta(domain, changed, as_of))


def create_impact_view(summary: DataFrame, name: str = "vw_ai_impact") -> DataFrame:
    """Registers the summary without its time stamp as a view and returns it."""
    summary.select(*FACT).createOrReplaceTempView(name)
    return summary.sparkSession.table(name)


def filter_summary(
    summary: DataFrame,
    project: int | None = None,
    author: int | None = None,
    team: int | None = None,
) -> DataFrame:
    if project is not None:
        summary = summary.where(F.col("project_id") == project)
    if author is not None:
        summary = summary.where(F.col("author_id") == author)
    if team is not None:
        summary = summary.where(F.array_contains("team_ids", F.lit(team).cast("bigint")))
    return summary


def issues_of_team(summary: DataFrame, team: int) -> DataFrame:
    return filter_summary(summary, team=team)


def impact_from_summary(
    domain: Domain,
    summary: DataFrame,
    project: int | None = None,
    author: int | None = None,
    engineer: int | None = None,
    team: int | None = None,
) -> DataFrame:
    """Summary figures read off the stored fact; the impact is NULL when no issue has AI commits."""
    rows = filter_summary(summary, project, author, team)
    if engineer is not None:
        own = domain.commits.where(F.col("engineer_id") == engineer).select(F.col("jira_issue_id").alias("issue_id"))
        rows = rows.join(own, "issue_id", "left_semi")
    figures = summarize(rows)
    defined = (F.col("issues_with_ai") > 0) | (F.col("avg_cycle_time_without_ai") <= 0)
    return figures.withColumn(
        "cycle_time_impact_percentage", F.when(defined, F.col("cycle_time_impact_percentage"))
    ).select(*SUMMARY)


def impact_from_summary_by(summary: DataFrame, *keys: str | Column) -> DataFrame:
    """`impact_from_summary` for every value of a key in one job."""
    figures = summarize(summary, *keys)
    defined = (F.col("issues_with_ai") > 0) | (F.col("avg_cycle_time_without_ai") <= 0)
    return figures.withColumn(
        "cycle_time_impact_percentage", F.when(defined, F.col("cycle_time_impact_percentage"))
    )
