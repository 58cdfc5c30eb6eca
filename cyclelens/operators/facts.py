"""Issue facts: commits rolled up to the grain at which cycle time is defined.

Commits are always aggregated before they meet another table. The partial aggregate runs next to the scan, so an issue,
engineer or team that owns a large share of the commits reaches the shuffle as a few rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclelens.domain import Domain
from cyclelens.functions.scalars import days_between
from cyclelens.operators.joins import lookup_join

ISSUE_COLUMNS = ("issue_id", "project_id", "author_id", "category", "resolution_date")


def commit_rollup(commits: DataFrame, *keys: str) -> DataFrame:
    """First and last commit date and commit counts per issue and further keys; unread columns are not computed."""
    return commits.groupBy(F.col("jira_issue_id").alias("issue_id"), *keys).agg(
        F.min("commit_date").alias("first_commit_date"),
        F.max("commit_date").alias("last_commit_date"),
        F.count(F.lit(1)).alias("total_commits"),
        F.count_if("ai_used").alias("ai_commits"),
    )


ROLLED = {"first_commit_date": F.min, "last_commit_date": F.max, "total_commits": F.sum, "ai_commits": F.sum}


def merge_rollups(rolled: DataFrame, *keys: str) -> DataFrame:
    """Rollups added up to a coarser grain, or rollups of separate commits to one."""
    return rolled.groupBy(*keys).agg(*[merge(c).alias(c) for c, merge in ROLLED.items() if c in rolled.columns])


def engineer_rollup(domain: Domain) -> DataFrame:
    """The commits per (issue, engineer): the grain every filtered view of them can be rebuilt from."""
    # A join on the engineer later would add this filter in some branches only, and they would not share a shuffle.
    return commit_rollup(domain.commits.where(F.col("engineer_id").isNotNull()), "engineer_id")


def measured(rolled: DataFrame) -> DataFrame:
    """Adds the measures of an analysed issue; they are NULL where the issue is unresolved or has no commits."""
    return rolled.withColumns(
        {
            "non_ai_commits": F.col("total_commits") - F.col("ai_commits"),
            "has_ai_commits": F.when(F.col("resolution_date").isNotNull(), F.col("ai_commits") > 0),
            "cycle_time": days_between("first_commit_date", "resolution_date"),
        }
    )


def commits_of(domain: Domain, engineer: int | None = None, team: int | None = None) -> DataFrame:
    """Commits by one engineer and / or the members of one team; a filter that is not given adds no predicate."""
    commits = domain.commits
    if engineer is not None:
        commits = commits.where(F.col("engineer_id") == engineer)
    if team is not None:
        chosen = domain.members.where(F.col("team_id") == team).select("engineer_id")
        commits = lookup_join(commits, chosen, "engineer_id", "left_semi")
    return commits


def resolved_issues(domain: Domain, project: int | None = None, author: int | None = None) -> DataFrame:
    issues = domain.resolved
    if project is not None:
        issues = issues.where(F.col("project_id") == project)
    if author is not None:
        issues = issues.where(F.col("author_id") == author)
    return issues


def issue_fact(
    domain: Domain,
    project: int | None = None,
    author: int | None = None,
    engineer: int | None = None,
    team: int | None = None,
) -> DataFrame:
    """One row per resolved issue that has a commit passing the filters, measured on those commits only.

    Both sides of the join are keyed by issue and hold one row per issue; the rolled-up side is already partitioned
    by issue, so only the issues are moved for the join.
    """
    rolled = commit_rollup(commits_of(domain, engineer, team))
    issues = resolved_issues(domain, project, author).select(*ISSUE_COLUMNS)
    return measured(issues.join(rolled, "issue_id"))


def every_issue(domain: Domain, rolled: DataFrame | None = None) -> DataFrame:
    """Like `issue_fact`, but issues that cannot be analysed stay, so each project, author and category has a row."""
    per_issue = commit_rollup(domain.commits) if rolled is None else merge_rollups(rolled, "issue_id")
    return measured(domain.jira_issues.select(*ISSUE_COLUMNS).join(per_issue, "issue_id", "left"))


def by_shifted_issue(rows: DataFrame) -> DataFrame:
    """Rows with a join key made from the issue id, which the optimizer does not take for the id itself.

    What is joined by issue after a join on this key is shuffled anew, so that the second join can be split by itself where a hot issue makes a
    partition large.
    """
    return rows.withColumn("_issue", -F.col("issue_id"))


def contributions(domain: Domain, every_engineer: bool = False, rolled: DataFrame | None = None) -> DataFrame:
    """One row per (resolved issue, engineer), from the commits or from their stored `engineer_rollup`.

    With `every_engineer`, commits to unresolved issues stay as rows without measures, so that each engineer who
    committed anything has a row. What groups by issue afterwards is partitioned by this join; a hot issue is still split (`session.adapt`).
    """
    rolled = engineer_rollup(domain) if rolled is None else rolled
    issues = domain.resolved.select(*ISSUE_COLUMNS)
    return measured(rolled.join(issues, "issue_id", "left" if every_engineer else "inner"))


def regroup(contributed: DataFrame, *keys: str, carry: Sequence[str] = ()) -> DataFrame:
    """Contributions merged to one row per (issue, keys), where they lie if partitioned by issue; else combined per task, then shuffled.

    Issue columns besides the resolution date are kept only if named in `carry`: what no later step reads is then not
    read from the source either.
    """
    return measured(merge_rollups(contributed, "issue_id", "resolution_date", *carry, *keys))


def by_team(domain: Domain, contributed: DataFrame, how: str = "inner") -> DataFrame:
    """Contributions repeated once per team of the engineer."""
    return lookup_join(contributed, domain.members, "engineer_id", how, domain.members_are_few)


def team_fact(domain: Domain, contributed: DataFrame | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One row per (issue, team): the issue as seen through the commits of that team's members."""
    shared = contributions(domain) if contributed is None else contributed
    return regroup(by_team(domain, shared), "team_id", carry=carry)
