"""The high-water refresh, sets of tables, moves that are cut short, and refreshes with bad entities."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cyclelens import schemas
from cyclelens.domain import StrictDomain
from cyclelens.operators import partitions
from cyclelens.operators.facts import engineer_rollup
from cyclelens.plans import high_water, refresh, stored_facts
from cyclelens.session import work_dir
from cyclelens.sources.buckets import BucketStore
from cyclelens.sources.load_set import LoadSets
from cyclelens.sources.storage import TableStore
from tests.conftest import ROWS, as_set, make_domain

AS_OF = datetime(2024, 3, 1)
MARK = date(2024, 1, 8)


class Stopped(BaseException):
    """What ends a process, so that no handler runs."""


def test_high_water_reads_new_months_only_and_goes_on_after_a_stop(spark, small, monkeypatch):
    folder = work_dir(spark, "high-water")
    partitions.write_by_month(small.commits, f"{folder}/commits")
    kept = high_water.ImpactTables(BucketStore(spark, f"{folder}/store", bucket_rows=1))
    kept.rebuild(small.having(commits=small.commits.where(F.col("commit_date") <= F.lit(MARK))), AS_OF)
    assert kept.mark() == MARK
    # From February on, January is not opened; the mark's own month is.
    read = high_water.commits_after(small, f"{folder}/commits", date(2024, 2, 1)).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("commit_month=")[1][:6] for r in read} == {"202402"}
    plan = high_water.commits_after(small, f"{folder}/commits", date(2024, 2, 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(commit_month" in plan
    real = kept.store.upsert

    def stopped(*a, **k):
        raise Stopped

    monkeypatch.setattr(kept.store, "upsert", stopped)
    with pytest.raises(Stopped):
        kept.advance(small, f"{folder}/commits", AS_OF)
    assert kept.mark() == MARK
    monkeypatch.setattr(kept.store, "upsert", real)
    whole = stored_facts.ai_impact_summary(small, AS_OF)
    assert as_set(kept.advance(small, f"{folder}/commits", AS_OF).select(whole.columns)) == as_set(whole)
    assert kept.mark() == date(2024, 2, 12)
    # Nothing new: nothing is written.
    version = kept.store._complete("ai_impact_summary")[-1]
    kept.advance(small, f"{folder}/commits", AS_OF)
    assert kept.store._complete("ai_impact_summary")[-1] == version
    for team in (1, 2, 3, 99):
        assert as_set(kept.issues_of_team(team).select(whole.columns)) == as_set(stored_facts.issues_of_team(whole, team))
    assert len(kept.store._list(high_water.POSTINGS)["files"]) > 1 and len({f.rsplit("/", 2)[1] for f in kept.issues_of_team(1).inputFiles()}) == 1


def test_a_set_is_published_whole_or_not_at_all(spark, small):
    sets = LoadSets(spark, work_dir(spark, "sets"))
    tables = {t: small.table(t) for t in schemas.TABLES}
    with pytest.raises(ValueError, match="lacks"):
        sets.load({"teams": small.teams})
    assert sets.load(tables).isEmpty()
    opened = sets.current().commits
    lost = small.engineers.where("id <> 4")
    repeated = small.projects.unionByName(small.projects.where("project_id = 2"))
    unnamed = small.teams.withColumn("team_name", F.when(F.col("team_id") > 1, F.col("team_name")))
    found = sets.load(tables | {"engineers": lost, "projects": repeated, "teams": unnamed})
    assert sorted(tuple(r) for r in found.collect()) == [("key", "projects", 1), ("null", "teams.team_name", 1), ("reference", "commits.engineer_id->engineers.id", 2)]
    assert as_set(sets.current().engineers) == as_set(small.engineers)
    # A load that breaks off in the middle: readers keep the old set.
    broken = small.repositories.withColumn("repo_name", F.raise_error(F.lit("cut")).cast("string"))
    with pytest.raises(Exception, match="cut"):
        sets.load(tables | {"teams": small.teams.limit(0), "repositories": broken})
    assert sets.current().teams.count() == 3
    # A table by itself is checked against the published others.
    assert sets.load({"teams": small.teams.where("team_id = 1")}).isEmpty()
    assert sets.current().teams.count() == 1 and sets.current().commits.count() == 7 and opened.count() == 7
    sets.expire(keep=1)
    assert sets.current().commits.count() == 7 and len(sets._folders()) == 1


@pytest.mark.parametrize("error", [RuntimeError, Stopped])
def test_a_move_is_undone_or_finished_wherever_it_stops(spark, small, monkeypatch, error):
    """The commit is the only one of its month, so a month is emptied and a new one made."""
    one = small.commits.where("commit_id in ('a', 'b', 'f', 'g')").withColumn("commit_date", F.when(F.col("commit_id") == "f", F.lit(date(2023, 5, 5))).otherwise(F.col("commit_date")))
    moved = as_set(partitions.redate(one, "f", date(2024, 3, 3)))
    before = as_set(one)
    for stop in range(5):
        folder = work_dir(spark, "move")
        partitions.write_by_month(one, f"{folder}/commits")
        calls = {"n": 0}
        real = partitions._Move._rename

        def rename(self, source, target, real=real, calls=calls, stop=stop):
            if calls["n"] == stop:
                calls["n"] += 1
                raise error("stopped")
            calls["n"] += 1
            real(self, source, target)

        monkeypatch.setattr(partitions._Move, "_rename", rename)
        ended = False
        try:
            partitions.recommit_date(spark, f"{folder}/commits", "f", date(2024, 3, 3), f"{folder}/staging")
            ended = True
        except error:
            pass
        monkeypatch.setattr(partitions._Move, "_rename", real)
        journal = partitions._Move(spark, f"{folder}/commits", f"{folder}/staging").months()
        if error is Stopped:
            partitions.recover_move(spark, f"{folder}/commits", f"{folder}/staging")
        rows = as_set(partitions.read_by_month(spark, f"{folder}/commits").drop("commit_month"))
        assert rows == (moved if ended or journal is not None else before), stop
        assert ended == (stop > calls["n"] - 1) or not ended
    with pytest.raises(LookupError):
        partitions.recommit_date(spark, f"{folder}/commits", "nowhere", date(2024, 3, 3), f"{folder}/staging")


def test_a_bad_entity_does_not_keep_the_others(spark):
    rows = ROWS | {"teams": [(1, "Core", "1, 2"), (2, "Edge", "3,x1"), (3, "Idle", "5"), (4, "More", "4")]}
    good = make_domain(spark, rows)
    strict = StrictDomain(spark, good._tables)
    store = TableStore(spark, work_dir(spark, "retries"))
    rolled = store.replace("rolled", engineer_rollup(good))
    tables = {"team": refresh.refresh_guarded(strict, store, "team", AS_OF, rolled=rolled, most_tries=2)}
    expected = refresh.metric_rows(good, "team").where("team_id <> 2")
    assert as_set(tables["team"].drop("last_calculated")) == as_set(expected)
    report = refresh.refresh_report(good, tables, AS_OF, failures=store.read("refresh_failures")).first()
    assert (report.processed, report.total, report.failed) == (3, 4, 1)
    [left] = store.read("refresh_retries").collect()
    assert (left.dimension, left.entity_key, left.tries) == ("team", "2", 1) and "x1" in left.message
    none = spark.createDataFrame([], "team_id long")
    refresh.refresh_guarded(strict, store, "team", AS_OF, none, rolled, most_tries=2)
    assert [r.tries for r in store.read("refresh_retries").collect()] == [2]
    # Tried often enough: left alone, and still noted. Once mended and asked for anew, it is refreshed.
    refresh.refresh_guarded(strict, store, "team", AS_OF, none, rolled, most_tries=2)
    assert [r.tries for r in store.read("refresh_retries").collect()] == [2]
    refresh.refresh_guarded(good, store, "team", AS_OF, none, rolled, most_tries=3)
    assert store.read("refresh_retries").isEmpty() and store.read(refresh.table_name("team")).count() == 4
