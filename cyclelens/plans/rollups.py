"""Metrics per team, engineer, project, author and category: one grouped job each, for all entities at once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclelens.domain import Domain
from cyclelens.functions.scalars import efficiency_score, id_list, instant, percent, share
from cyclelens.operators.facts import (
    contributions,
    every_issue,
    issue_fact,
    team_fact,
)
from cyclelens.operators.joins import BROADCAST_ROWS, lookup_join
from cyclelens.operators.ranking import nest_ranked, page, top_k
from cyclelens.operators.summarize import SUMMARY, coarser, for_every, summarize, summary_of, tally
from cyclelens.sources.storage import TableStore


def scored(summary: DataFrame) -> DataFrame:
    """The summary with the efficiency score."""
    score = efficiency_score("cycle_time_impact_percentage", "avg_commits_with_ai", "avg_commits_without_ai")
    return summary.withColumn("efficiency_score", score)


def _stamped(summary: DataFrame, as_of: datetime) -> DataFrame:
    return summary.withColumn("last_calculated", instant(as_of))


# -- teams ------------------------------------------------------------------------------------------------------------


def team_metrics(domain: Domain) -> DataFrame:
    """One row per team, zeros for a team without analysed issues."""
    teams = domain.teams.select("team_id", "team_name", F.size(id_list("engineer_ids")).alias("engineer_count"))
    return for_every(teams, summarize(team_fact(domain), "team_id"), "team_id")


def category_shares(tallied: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The k most frequent categories of each entity with their AI share, ranked; from a tally by (key, category)."""
    counted = tallied.withColumn("issue_count", F.col("issues_with_ai") + F.col("issues_without_ai"))
    return top_k(counted, key, "issue_count", "category", k).select(
        key, "rank", "category", "issue_count", percent("issues_with_ai", "issue_count").alias("ai_percentage")
    )


def team_categories(domain: Domain, rolled: DataFrame | None = None) -> DataFrame:
    """Tally by (team, category)."""
    fact = team_fact(domain, contributions(domain, rolled=rolled), carry=("category",))
    return tally(fact, "team_id", "category")


def top_categories(domain: Domain, k: int = 5) -> DataFrame:
    return category_shares(team_categories(domain), "team_id", k)


def team_rows(domain: Domain, tallied: DataFrame) -> DataFrame:
    """A row per team from the tally by (team, category): summary, adoption as a fraction, nested top categories."""
    rows = for_every(domain.teams.select("team_id"), summary_of(coarser(tallied, "team_id")), "team_id")
    entry = F.struct(
        "category", F.col("issue_count").alias("issueCount"), F.col("ai_percentage").alias("aiPercentage")
    )
    nested = nest_ranked(category_shares(tallied, "team_id"), "team_id", "top_categories", entry)
    empty = F.array().cast("array<struct<category:string,issueCount:bigint,aiPercentage:double>>")
    return (
        rows.withColumn("ai_adoption_rate", share("issues_with_ai", "total_issues"))
        .join(nested, "team_id", "left")
        .withColumn("top_categories", F.coalesce("top_categories", empty))
    )


def team_metrics_materialized(domain: Domain, store: TableStore, as_of: datetime) -> DataFrame:
    """The stored team rows, time-stamped.

    Summary and ranking both come from the tally by (team, category). It is written once and is as small as its keys;
    the commits are read a single time.
    """
    return _stamped(team_rows(domain, store.replace("team_categories", team_categories(domain))), as_of)


def team_metrics_with_info(stored: DataFrame, teams: DataFrame) -> DataFrame:
    """Stored team metrics joined with the team's name and size, in team order."""
    info = teams.select("team_id", "team_name", F.size(id_list("engineer_ids")).alias("engineer_count"))
    return stored.join(info, "team_id").orderBy("team_id")


# -- engineers --------------------------------------------------------------------------------------------------------


def engineer_metrics(domain: Domain) -> DataFrame:
    """One row per engineer on record, zeros for an engineer without analysed issues."""
    engineers = domain.engineers.select(F.col("id").alias("engineer_id"), F.col("name").alias("engineer_name"))
    return for_every(engineers, summarize(contributions(domain), "engineer_id"), "engineer_id")


def engineer_metrics_scored(domain: Domain) -> DataFrame:
    """One row per engineer who committed anything, with the efficiency score."""
    return scored(summarize(contributions(domain, every_engineer=True), "engineer_id"))


def engineer_metrics_page(domain: Domain, batch: int = 100, offset: int = 0) -> DataFrame:
    """One page of engineers by id as nested documents; only commits of the engineers on the page are rolled up."""
    chosen = page(domain.engineers, "id", batch, offset)
    keys = chosen.select(F.col("id").alias("engineer_id"))
    commits = lookup_join(domain.commits, keys, "engineer_id", "left_semi", batch <= BROADCAST_ROWS)
    metrics = engineer_metrics(domain.having(engineers=chosen, commits=commits))
    return metrics.select("engineer_id", "engineer_name", F.struct(*SUMMARY).alias("metrics")).orderBy("engineer_id")


# -- projects, authors, categories ------------------------------------------------------------------------------------


def project_metrics(domain: Domain) -> DataFrame:
    """One row per project on record, zeros for a project without analysed issues."""
    return for_every(domain.projects, summarize(issue_fact(domain), "project_id"), "project_id")


def project_metrics_materialized(domain: Domain, as_of: datetime) -> DataFrame:
    """One row per project that has issues."""
    return _stamped(summarize(every_issue(domain), "project_id"), as_of)


def author_metrics(domain: Domain, match: str = "author") -> DataFrame:
    """One scored row per issue author, over the issues written (`author`) or the commits made (`engineer`)."""
    if match == "author":
        return scored(summarize(every_issue(domain), "author_id"))
    if match != "engineer":
        raise ValueError(f"Unknown match: {match}")
    authors = domain.jira_issues.select("author_id").distinct()
    own = summarize(contributions(domain).withColumnRenamed("author_id", "_written_by"), F.col("engineer_id").alias("author_id"))
    return scored(for_every(authors, own, "author_id"))


def category_metrics(domain: Domain) -> DataFrame:
    """One row per issue category."""
    return summarize(every_issue(domain), "category")
