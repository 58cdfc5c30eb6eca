"""Aggregates behind the dashboard: filter lists, chart series, improvements and the combined request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclelens.domain import Domain
from cyclelens.functions.scalars import improvement_label, share, to_fixed
from cyclelens.operators.facts import contributions, lookup_join, regroup, team_fact
from cyclelens.operators.summarize import SUMMARY, coarser, summarize, summary_of, tally
from cyclelens.plans.stored_facts import filter_summary


def filter_options(domain: Domain) -> DataFrame:
    """(dimension, id, name) of everything the dashboard can filter by."""

    def options(df: DataFrame, dimension: str, key: str, name: str) -> DataFrame:
        return df.select(F.lit(dimension).alias("dimension"), F.col(key).alias("id"), F.col(name).alias("name"))

    return (
        options(domain.teams, "teams", "team_id", "team_name")
        .unionByName(options(domain.projects, "projects", "project_id", "project_name"))
        .unionByName(options(domain.engineers, "engineers", "id", "name"))
    )


def category_chart(
    summary: DataFrame,
    team: int | None = None,
    project: int | None = None,
    engineer: int | None = None,
    mode: str = "average",
) -> DataFrame:
    """Cycle time per category beside each other for both AI groups, 0 where a group is empty.

    The engineer filter compares the issue's author. `first` shows the issue with the lowest id instead of the mean.
    """
    rows = filter_summary(summary, project=project, author=engineer, team=team)
    ai, no_ai = F.col("has_ai_commits"), ~F.col("has_ai_commits")

    def value(group):
        if mode == "average":
            return F.avg(F.when(group, F.col("cycle_time")))
        if mode == "first":
            return F.min(F.when(group, F.struct("issue_id", "cycle_time")))["cycle_time"].cast("double")
        raise ValueError(f"Unknown mode: {mode}")

    return rows.groupBy("category").agg(
        F.coalesce(value(ai), F.lit(0.0)).alias("ai_cycle_time"),
        F.coalesce(value(no_ai), F.lit(0.0)).alias("non_ai_cycle_time"),
    )


def project_improvements(fact: DataFrame) -> DataFrame:
    """Improvement of the AI group over the other, for projects that have both; one pass, no self join."""
    both = summarize(fact, "project_id").where((F.col("issues_with_ai") > 0) & (F.col("issues_without_ai") > 0))
    ai, no_ai = F.col("avg_cycle_time_with_ai"), F.col("avg_cycle_time_without_ai")
    return both.select(
        "project_id",
        ai.alias("ai_time"),
        no_ai.alias("non_ai_time"),
        to_fixed(F.try_divide(no_ai - ai, no_ai) * 100).alias("improvement"),
        F.col("issues_with_ai").alias("ai_issue_count"),
        F.col("issues_without_ai").alias("non_ai_issue_count"),
    )


def overall_improvement(improvements: DataFrame) -> DataFrame:
    """Mean improvement weighted by issue count, total counts and a label; zeros for no projects."""
    weight = F.col("ai_issue_count") + F.col("non_ai_issue_count")
    totals = improvements.agg(
        F.sum(F.col("improvement") * weight).alias("_sum"),
        F.sum(weight).alias("_weight"),
        F.coalesce(F.sum("ai_issue_count"), F.lit(0)).alias("total_ai_issues"),
        F.coalesce(F.sum("non_ai_issue_count"), F.lit(0)).alias("total_non_ai_issues"),
    )
    percentage = to_fixed(share("_sum", "_weight"))
    return totals.select(
        percentage.alias("percentage"), "total_ai_issues", "total_non_ai_issues", improvement_label(percentage).alias("status")
    )


def dashboard_bundle(domain: Domain) -> DataFrame:
    """For every observed (team, project): the pair's figures beside the team's own.

    The team's tally is the sum of its pairs' tallies, so both sides share one rollup (exchange reuse).
    """
    tallied = tally(team_fact(domain, carry=("project_id",)), "team_id", "project_id")
    team = summary_of(coarser(tallied, "team_id"))
    return summary_of(tallied).join(team.select("team_id", *[F.col(c).alias(f"team_{c}") for c in SUMMARY]), "team_id")


def dashboard_for(domain: Domain, team: int, project: int, engineer: int | None = None) -> DataFrame:
    """The parts of one dashboard request as rows (part, figures); every part reads the shared contributions."""
    shared = contributions(domain)
    of_team = regroup(
        lookup_join(
            shared, domain.members.where(F.col("team_id") == team), "engineer_id", "inner", domain.members_are_few
        ),
        "team_id",
        carry=("project_id",),
    )

    def part(name: str, summary: DataFrame) -> DataFrame:
        return summary.select(F.lit(name).alias("part"), *SUMMARY)

    impact = part("impact", summarize(of_team.where(F.col("project_id") == project)))
    rows = impact.unionByName(part("team", summarize(of_team)))
    if engineer is not None:
        rows = rows.unionByName(part("engineer", summarize(shared.where(F.col("engineer_id") == engineer))))
    return rows


def named_projects(improvements: DataFrame, domain: Domain) -> DataFrame:
    return improvements.join(domain.projects, "project_id")
