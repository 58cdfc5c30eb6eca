"""The impact summary kept by a high-water mark: a refresh reads the commits after the mark and what they touch.

Stored beside the summary are the rollup per (issue, engineer) it was made from and the mark, the day of the last commit taken
in. A refresh reads the months from the mark's on, adds their rollup to the buckets of the issues concerned, and makes these
issues' rows anew from there: earlier commits are not read again. The postings hold the rows once more by team, so that the
issues of one team are one bucket.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclelens.domain import Domain
from cyclelens.operators.facts import engineer_rollup, merge_rollups
from cyclelens.operators.partitions import read_by_month
from cyclelens.plans import stored_facts
from cyclelens.sources.buckets import BucketStore

SUMMARY_TABLE, ROLLUP, POSTINGS, MARK, ARRIVED = "ai_impact_summary", "impact_rollup", "impact_by_team", "impact_mark", "impact_arrived"


def commits_after(domain: Domain, folder: str, mark: date | None) -> DataFrame:
    """Commits stored by month that are later than the mark; months before the mark's are not opened."""
    commits = read_by_month(domain.spark, folder)
    if mark is None:
        return commits.drop("commit_month")
    return commits.where((F.col("commit_month") >= mark.year * 100 + mark.month) & (F.col("commit_date") > F.lit(mark))).drop("commit_month")


def posted(summary: DataFrame) -> DataFrame:
    """The summary's rows once for each of their teams."""
    return summary.select(F.explode("team_ids").alias("team_id"), *summary.columns)


class ImpactTables:
    """The summary, its rollup, postings and mark in one store. One writer at a time."""

    def __init__(self, store: BucketStore):
        self.store = store

    def mark(self) -> date | None:
        """The day up to which commits have been taken in; a commit that comes later with an earlier day is for the streams to take in."""
        return self.store.read(MARK).first()[0] if self.store.exists(MARK) else None

    def rebuild(self, domain: Domain, as_of: datetime) -> DataFrame:
        """Everything anew from all commits of the domain."""
        rolled = self.store.deal(ROLLUP, engineer_rollup(domain), "issue_id")
        summary = self.store.deal(SUMMARY_TABLE, stored_facts.ai_impact_summary(domain, as_of, rolled), "issue_id")
        self._post(summary)
        self.store.replace(MARK, rolled.agg(F.coalesce(F.max("last_commit_date"), F.lit("0001-01-01").cast("date")).alias("mark")))
        return summary

    def _post(self, summary: DataFrame) -> None:
        """All postings from the stored summary: their number is read off it, so they are not staged to be counted."""
        rows = posted(summary)
        self.store.deal(POSTINGS, rows, "team_id", self.store.buckets_for(rows))

    def advance(self, domain: Domain, folder: str, as_of: datetime) -> DataFrame:
        """The summary with the commits in `folder` after the mark taken in; `domain` gives the other tables.

        The new commits' rollup is stored with the mark it leads to before anything changes. A run that stops halfway is taken up from there by
        the next one: the rollup is tagged with the mark, so nothing is added twice.
        """
        mark = self.mark()
        if mark is None:
            return self.rebuild(domain.having(commits=commits_after(domain, folder, None)), as_of)
        target = self.store.tag(ARRIVED) if self.store.exists(ARRIVED) else None
        if target is not None and target > mark.toordinal():
            self._take_in(domain, date.fromordinal(target), as_of)
            mark = self.mark()
        newer = self.store.replace(f"{ARRIVED}_next", engineer_rollup(domain.having(commits=commits_after(domain, folder, mark))))
        until = newer.agg(F.max("last_commit_date")).first()[0]
        if until is not None:
            self.store.deal(ARRIVED, newer, (), 1, tag=until.toordinal())
            self._take_in(domain, until, as_of)
        return self.store.read(SUMMARY_TABLE)

    def _take_in(self, domain: Domain, until: date, as_of: datetime) -> None:
        store, arrived = self.store, self.store.read(ARRIVED)
        if store.tag(ROLLUP) != until.toordinal():
            store.modify(ROLLUP, arrived, "issue_id", lambda old, new: merge_rollups(old.unionByName(new), "issue_id", "engineer_id"), tag=until.toordinal())
        issues = store.replace("impact_issues", arrived.select("issue_id").distinct())
        rows = stored_facts.ai_impact_summary(domain, as_of, store.lookup(ROLLUP, issues))
        before = store.replace("impact_before", posted(store.lookup(SUMMARY_TABLE, issues)).select("team_id", "issue_id"))
        store.upsert(SUMMARY_TABLE, rows, "issue_id", gone=issues)
        if store.touches_most(POSTINGS, before):
            # Nearly all buckets would be read, joined and written: the summary's rows by team are the same and need no join.
            self._post(store.read(SUMMARY_TABLE))
        else:
            store.upsert(POSTINGS, posted(store.lookup(SUMMARY_TABLE, issues)), ("team_id", "issue_id"), gone=before, by="team_id")
        store.replace(MARK, store.spark.createDataFrame([(until,)], "mark date"))
        for name in (ROLLUP, SUMMARY_TABLE, POSTINGS, MARK, ARRIVED, f"{ARRIVED}_next", "impact_issues", "impact_before", *(f"{t}_{x}" for t in (SUMMARY_TABLE, POSTINGS) for x in ("delta", "gone"))):
            if store.exists(name):
                store.expire(name)

    def issues_of_team(self, team: int) -> DataFrame:
        """The summary's rows that name the team: one bucket of the postings. Rows that no longer name it, left by a stopped run, are not shown."""
        wanted = self.store.spark.createDataFrame([(team,)], "team_id long")
        found = self.store.lookup(POSTINGS, wanted)
        return found.where(F.array_contains("team_ids", F.lit(team).cast("bigint"))).drop("team_id")
