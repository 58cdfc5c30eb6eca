"""Streams end in the state a batch run gives, whatever the batches and however often one is run."""

from datetime import date, datetime

from pyspark.sql import functions as F

from cyclelens.plans import refresh, stored_facts
from cyclelens.session import work_dir
from cyclelens.sources.storage import TableStore
from cyclelens.streaming import refresh as streams
from tests.conftest import as_set

AS_OF = datetime(2024, 3, 1)


DAYS = [(date(2023, 1, 1), date(2024, 1, 2)), (date(2024, 1, 3), date(2024, 1, 8)), (date(2024, 1, 9), date(2024, 12, 31))]


def _arrive(domain, folder, span):
    domain.commits.where(F.col("commit_date").between(*span)).coalesce(1).write.mode("append").parquet(folder)


def test_affected_refresh_equals_batch(spark, small):
    folder = work_dir(spark, "stream")
    store = TableStore(spark, f"{folder}/store")
    for span in DAYS:
        _arrive(small, f"{folder}/in", span)
        stream = streams.commit_stream(spark, f"{folder}/in", files_per_batch=1)
        streams.affected_refresh(stream, small, store, f"{folder}/checkpoint", AS_OF).awaitTermination()
    assert not store.exists("refresh_failures")
    for dimension in refresh.REFRESHED:
        key = refresh.KEYS[dimension]
        concerned = refresh.keys_of(refresh.affected_entities(small.commits, small), dimension)
        batch = refresh.metric_rows(small, dimension).join(concerned, key, "left_semi")
        assert as_set(store.read(refresh.table_name(dimension)).drop("last_calculated")) == as_set(batch)


def test_incremental_summary_equals_batch(spark, small):
    folder = work_dir(spark, "stream")
    store = TableStore(spark, f"{folder}/store")
    for span in DAYS:
        _arrive(small, f"{folder}/in", span)
    stream = streams.commit_stream(spark, f"{folder}/in", files_per_batch=1)
    streams.incremental_summary(stream, small, store, f"{folder}/checkpoint", AS_OF).awaitTermination()
    assert as_set(store.read("ai_impact_summary")) == as_set(stored_facts.ai_impact_summary(small, AS_OF))


def test_a_repeated_batch_changes_nothing(spark, small):
    store = TableStore(spark, work_dir(spark, "repeat"))
    first = small.commits.where("commit_date <= DATE '2024-01-05'")
    second = small.commits.where("commit_date > DATE '2024-01-05'")
    streams._absorb(small, store, "repeat", None, first, 0)
    once = as_set(streams._absorb(small, store, "repeat", None, second, 1)[1])
    assert once == as_set(streams._absorb(small, store, "repeat", None, second, 1)[1])
    from cyclelens.operators.facts import engineer_rollup

    assert once == as_set(engineer_rollup(small))


def test_failing_dimension_is_noted_and_others_go_on(spark, small, monkeypatch):
    folder = work_dir(spark, "failing")
    store = TableStore(spark, f"{folder}/store")
    real = refresh.refresh

    def failing(domain, store, dimension, *rest):
        if dimension == "team":
            raise RuntimeError("no teams today")
        return real(domain, store, dimension, *rest)

    monkeypatch.setattr(refresh, "refresh", failing)
    _arrive(small, f"{folder}/in", (date(2023, 1, 1), date(2024, 12, 31)))
    stream = streams.commit_stream(spark, f"{folder}/in")
    streams.affected_refresh(stream, small, store, f"{folder}/checkpoint", AS_OF).awaitTermination()
    assert [(r.dimension, r.message) for r in store.read("refresh_failures").collect()] == [("team", "no teams today")]
    assert store.exists(refresh.table_name("engineer")) and not store.exists(refresh.table_name("team"))


def test_team_only_refresh(spark, small):
    folder = work_dir(spark, "teams")
    store = TableStore(spark, f"{folder}/store")
    _arrive(small, f"{folder}/in", (date(2023, 1, 1), date(2024, 12, 31)))
    stream = streams.commit_stream(spark, f"{folder}/in")
    streams.affected_refresh(stream, small, store, f"{folder}/c", AS_OF, dimensions=("team",)).awaitTermination()
    assert store.read(refresh.table_name("team")).count() == 2 and not store.exists(refresh.table_name("project"))


def test_changed_issues_refresh_both_projects(spark, small):
    store = TableStore(spark, work_dir(spark, "changes"))
    refresh.refresh_all(small, store, datetime(2024, 2, 1), force=True)
    moved = small.jira_issues.withColumn("project_id", F.when(F.col("issue_id") == 11, 2).otherwise(F.col("project_id")))
    after = small.having(jira_issues=moved)
    tables = streams.changed_tables_refresh(after, store, AS_OF, issues_before=small.jira_issues)
    assert as_set(tables["project"].drop("last_calculated")) == as_set(refresh.metric_rows(after, "project"))
    touched = tables["category"].where(F.col("last_calculated") == F.lit("2024-03-01").cast("timestamp_ntz"))
    assert [r.category for r in touched.collect()] == ["bug"]


def test_changed_team_is_refreshed(spark, small):
    store = TableStore(spark, work_dir(spark, "changes"))
    refresh.refresh_all(small, store, datetime(2024, 2, 1), force=True)
    grown = small.teams.withColumn("engineer_ids", F.when(F.col("team_id") == 3, "4").otherwise(F.col("engineer_ids")))
    after = small.having(teams=grown)
    tables = streams.changed_tables_refresh(after, store, AS_OF, teams_before=small.teams)
    assert as_set(tables["team"].drop("last_calculated")) == as_set(refresh.metric_rows(after, "team"))


def test_a_stream_goes_on_from_stored_tables(spark, small):
    """Tables made from the first commits, a stream of the last: the same as from all of them; no history is lost."""
    folder = work_dir(spark, "stream")
    store = TableStore(spark, f"{folder}/store")
    early = small.having(commits=small.commits.where(F.col("commit_date") <= DAYS[1][1]))
    refresh.refresh_all(early, store, datetime(2024, 2, 1))
    store.replace("ai_impact_summary", stored_facts.ai_impact_summary(early, datetime(2024, 2, 1)))
    rollup = store.read("engineer_rollup").collect()
    _arrive(small, f"{folder}/in", DAYS[2])
    for run, mark in ((streams.affected_refresh, "a"), (streams.incremental_summary, "b")):
        stream = streams.commit_stream(spark, f"{folder}/in", files_per_batch=1)
        run(stream, small, store, f"{folder}/checkpoint-{mark}", AS_OF, history=early.commits).awaitTermination()
    # Both streams, and the batch refresh, keep their own state.
    assert store.read("engineer_rollup").collect() == rollup
    for dimension in refresh.REFRESHED:
        stored = store.read(refresh.table_name(dimension)).drop("last_calculated")
        assert as_set(stored) == as_set(refresh.metric_rows(small, dimension).select(stored.columns))
    whole = stored_facts.ai_impact_summary(small, AS_OF).drop("last_updated")
    assert as_set(store.read("ai_impact_summary").drop("last_updated")) == as_set(whole)


def test_a_stream_does_not_start_blind(spark, small):
    import pytest

    folder = work_dir(spark, "stream")
    store = TableStore(spark, f"{folder}/store")
    refresh.refresh_all(small, store, AS_OF)
    _arrive(small, f"{folder}/in", DAYS[0])
    with pytest.raises(ValueError, match="history"):
        streams.affected_refresh(streams.commit_stream(spark, f"{folder}/in"), small, store, f"{folder}/c", AS_OF)
