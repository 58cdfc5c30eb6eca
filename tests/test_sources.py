"""CSV ingest, stored tables, quality checks and month partitions."""

from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cyclelens import schemas
from cyclelens.domain import Domain
from cyclelens.operators import partitions, periods, quality
from cyclelens.operators.merge import changed_rows, replace_rows, stale_keys
from cyclelens.session import work_dir
from cyclelens.sources import csv, tables
from cyclelens.sources.storage import TableStore, bulk_replace
from tests.conftest import ROWS, as_set, make_domain, rows_by

ISSUES = """project_id,issue_id,author_id,creation_date,resolution_date,category
1,10,1,2024-01-01,2024-01-09,"bug, urgent"
1,12abc,1,2024-01-01,,docs
2,13,1,2024-01-02
1,14,1,2024-01-01,2024-01-09,bug,extra
1,x,1,2024-01-01,2024-01-09,bug
1,15,1,never,2024-01-09,bug
"""


@pytest.fixture
def issues_csv(tmp_path):
    path = tmp_path / "jira_issues.csv"
    path.write_text(ISSUES)
    return str(path)


def test_columns_bind_by_name_and_flawed_lines_are_set_aside(spark, issues_csv):
    loaded = csv.ingest(spark, issues_csv, "jira_issues", mode="quarantine")
    rows = rows_by(loaded.accepted, "issue_id")
    assert sorted(rows) == [10, 12]
    assert rows[10]["category"] == "bug, urgent" and rows[10]["project_id"] == 1
    assert rows[12]["resolution_date"] is None
    assert sorted(r.line for r in loaded.rejected.collect()) == ["1,14,1,2024-01-01,2024-01-09,bug,extra", "2,13,1,2024-01-02"]
    assert sorted(r.invalid_columns for r in loaded.invalid.collect()) == ["creation_date", "issue_id"]


def test_strict_load_fails_on_an_unreadable_value(spark, issues_csv):
    with pytest.raises(PySparkException):
        csv.ingest(spark, issues_csv, "jira_issues").accepted.collect()


def test_boolean_words(spark, tmp_path):
    path = tmp_path / "commits.csv"
    lines = [f"{c},1,1,1,2024-01-01,{w},5" for c, w in zip("abcd", ("TRUE", "False", "", "yes"))]
    path.write_text("\n".join([",".join(schemas.columns("commits")), *lines]))
    rows = rows_by(csv.ingest(spark, str(path), "commits").accepted, "commit_id")
    assert [rows[c]["ai_used"] for c in "abcd"] == [True, False, False, False]


def test_bad_arguments(spark, tmp_path):
    with pytest.raises(ValueError):
        csv.ingest(spark, "", "commits")
    with pytest.raises(ValueError):
        csv.ingest(spark, str(tmp_path), "users")
    with pytest.raises(FileNotFoundError):
        csv.ingest(spark, str(tmp_path / "none.csv"), "commits")
    (tmp_path / "teams.csv").write_text("team_id,team_name\n1,a\n")
    with pytest.raises(ValueError, match="engineer_ids"):
        csv.ingest(spark, str(tmp_path / "teams.csv"), "teams")


def test_bulk_load_is_all_or_nothing(spark, tmp_path):
    store = TableStore(spark, work_dir(spark, "bulk"))
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("id,name\n1,Ada\n2,Bo\n")
    bad.write_text("id,name\n1,Ada\nx,Bo\n")
    bulk_replace(store, "engineers", csv.bulk_read(spark, str(good), "engineers"))
    with pytest.raises(Exception):
        bulk_replace(store, "engineers", csv.bulk_read(spark, str(bad), "engineers"))
    assert store.read("engineers").count() == 2


def test_seeding_skips_missing_files(spark, tmp_path, small, caplog):
    for table in schemas.TABLES[:4]:
        csv.write_csv(small.table(table), str(tmp_path / f"{table}.csv"))
    loaded = tables.seed_all(spark, str(tmp_path))
    assert list(loaded) == list(schemas.TABLES[:4]) and "commits.csv" in caplog.text
    assert as_set(loaded["teams"].accepted) == as_set(small.teams)


def test_csv_round_trip_of_all_tables(spark, tmp_path, small):
    for table in schemas.TABLES:
        csv.write_csv(small.table(table), str(tmp_path / f"{table}.csv"))
    loaded = tables.seed_all(spark, str(tmp_path))
    again = Domain.from_tables({t: i.accepted for t, i in loaded.items()})
    for table in schemas.TABLES:
        assert as_set(again.table(table)) == as_set(small.table(table))


def test_domain_from_stored_folder(spark, tmp_path, small):
    for table in schemas.TABLES:
        small.table(table).write.parquet(str(tmp_path / table))
    assert Domain.from_folder(spark, str(tmp_path)).commits.count() == len(ROWS["commits"])
    with pytest.raises(ValueError):
        small.table("users")


def test_load_counts(spark, issues_csv):
    raw = csv.read_raw(spark, issues_csv)
    judged = csv.typed_projection(raw.where(F.col(csv.BAD_LINE).isNull()), "jira_issues", "quarantine")
    row = csv.load_metrics(judged, "jira_issues").first()
    assert (row.total, row.successful, row.failed) == (4, 2, 2)


def test_sample_and_lookup_arguments(small):
    assert [r.id for r in tables.table_sample(small, "engineers", 2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        tables.table_sample(small, "engineers", 0)
    with pytest.raises(ValueError):
        tables.metrics_lookup(small.engineers, "id", 0)


def test_upsert_is_idempotent_and_keeps_other_rows(spark):
    store = TableStore(spark, work_dir(spark, "upsert"))
    store.upsert("m", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "k")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = as_set(store.upsert("m", new, "k"))
    assert once == as_set(store.upsert("m", new, "k"))
    assert rows_by(store.read("m"), "k")[1]["v"] == "a" and rows_by(store.read("m"), "k")[2]["v"] == "c"


def test_an_unfinished_write_is_not_read(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.replace("m", spark.range(3))
    (tmp_path / "m" / "v0000000002").mkdir()
    assert store.read("m").count() == 3
    assert store.replace("m", spark.range(5)).count() == 5 and store.read("m").count() == 5
    with pytest.raises(LookupError):
        store.read("other")


def test_expired_versions_go_and_the_newest_stay(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    for n in range(5):
        store.replace("m", spark.range(n))
    store.expire("m", keep=2)
    assert store._versions("m") == ["v0000000004", "v0000000005"] and store.read("m").count() == 4
    store.expire("none")


@settings(max_examples=60, deadline=None)
@given(st.dates(date(1990, 1, 1), date(2040, 1, 1)), st.integers(0, 900), st.sampled_from(list(periods.STEPS)))
def test_periods_follow_each_other_without_gap(start, days, interval):
    end = start + timedelta(days=days)
    listed = periods.period_list(start, end, interval)
    assert listed[0][0] == start and listed[-1][0] <= end <= listed[-1][1]
    for (_, last), (following, _) in zip(listed, listed[1:]):
        assert following == last + timedelta(days=1)


def test_replace_rows_on_two_keys(spark):
    old = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "x int, y int, v string")
    new = spark.createDataFrame([(1, 2, "c")], "x int, y int, v string")
    assert sorted(r.v for r in replace_rows(old, new, ["x", "y"]).collect()) == ["a", "c"]


def test_stale_keys(spark):
    entities = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    stored = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 3))], "k int, last_calculated timestamp_ntz")
    cutoff = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    assert sorted(r.k for r in stale_keys(entities, stored, "k", cutoff).collect()) == [1, 3]


def test_changed_rows_treat_null_as_a_value(spark):
    old = spark.createDataFrame([(1, None, "x"), (2, 5, "x"), (3, 5, "x")], "k int, v int, w string")
    new = spark.createDataFrame([(1, None, "y"), (2, None, "x"), (3, 5, "x"), (4, 1, "x")], "k int, v int, w string")
    assert sorted(r.k for r in changed_rows(new, old, "k", ["v"]).collect()) == [2, 4]


def test_quality_checks(spark):
    rows = dict(ROWS)
    rows["commits"] = [*ROWS["commits"], ROWS["commits"][0], ("z", 99, 10, 1, date(2024, 1, 1), True, 1)]
    flawed = make_domain(spark, rows)
    assert [(r.table_name, r.key, r.copies) for r in quality.pk_duplicates(flawed).collect()] == [("commits", "a|2024-01-01", 2)]
    orphans = {r.edge: r.n_orphans for r in quality.fk_orphans(flawed).collect()}
    assert orphans["commits.engineer_id->engineers.id"] == 1 and sum(orphans.values()) == 1
    loose = flawed.having(engineers=spark.createDataFrame([(1, None), (None, "x")], "id long, name string"))
    nulls = {(r.table_name, r.column_name): r.nulls for r in quality.null_violations(loose).collect()}
    assert nulls["engineers", "id"] == 1 and nulls["engineers", "name"] == 1 and nulls["teams", "team_id"] == 0


@pytest.mark.parametrize(
    "documents, message",
    [
        ([], "No metrics retrieved"),
        (["[1]"], "Invalid JSON structure"),
        (['{"a":1}'], "Missing required JSON keys"),
        (['{"a":1,"b":{}}'], ""),
    ],
)
def test_document_validation(spark, documents, message):
    df = spark.createDataFrame([(d,) for d in documents], "doc string")
    row = quality.metrics_validation(df, "doc", ("a", "b")).first()
    assert row.message == message and row.ok == (message == "")


def test_month_periods_drift_from_a_month_end():
    starts = [p[0] for p in periods.period_list(date(2024, 1, 31), date(2024, 5, 1), "month")]
    assert starts == [date(2024, 1, 31), date(2024, 2, 29), date(2024, 3, 29), date(2024, 4, 29)]
    assert periods.period_list(date(2024, 1, 1), date(2024, 1, 10), "week")[-1] == (date(2024, 1, 8), date(2024, 1, 14))
    assert periods.period_list(date(2024, 1, 1), date(2024, 6, 1), "quarter")[1] == (date(2024, 4, 1), date(2024, 6, 30))
    with pytest.raises(ValueError):
        periods.period_list(date(2024, 1, 1), date(2024, 2, 1), "year")


def test_every_day_of_the_calendar_has_one_period(spark):
    days = periods.period_calendar(spark, date(2024, 1, 31), date(2024, 12, 31), "month")
    assert days.count() == days.select("day").distinct().count()


def test_partition_plan_ends_before_the_end_date(spark):
    plan = partitions.partition_plan(spark, date(2024, 1, 15), date(2024, 3, 1)).collect()
    assert [r.partition_name for r in plan] == ["commits_202401", "commits_202402"]


def test_retention_splits_and_plans(spark, small):
    kept, archived = partitions.split_by_age(small.commits, date(2024, 3, 10), months_to_keep=1)
    assert kept.count() == 2 and archived.count() == 5
    report = rows_by(partitions.partition_retention(small.commits, date(2024, 3, 10), 1, archive=False), "partition_name")
    assert report["commits_202401"]["action"] == "detached" and report["commits_202402"]["action"] == "kept"
    assert sorted(k for k, r in report.items() if r["action"] == "planned") == [
        "commits_202403",
        "commits_202404",
        "commits_202405",
    ]


def test_redating_rewrites_only_two_months(spark, small, tmp_path):
    path = str(tmp_path / "commits")
    partitions.write_by_month(small.commits, path)
    partitions.recommit_date(spark, path, "g", date(2024, 3, 3), str(tmp_path / "staging"))
    stored = rows_by(partitions.read_by_month(spark, path), "commit_id")
    assert len(stored) == 7 and stored["g"]["commit_date"] == date(2024, 3, 3) and stored["g"]["commit_month"] == 202403
    partitions.recommit_date(spark, path, "g", date(2024, 1, 1), str(tmp_path / "staging2"))
    assert not (tmp_path / "commits" / "commit_month=202403").exists()
    assert partitions.read_by_month(spark, path).count() == 7
    with pytest.raises(LookupError):
        partitions.recommit_date(spark, path, "none", date(2024, 1, 1), str(tmp_path / "staging3"))


def test_month_filter_prunes_folders(spark, small, tmp_path):
    path = str(tmp_path / "commits")
    partitions.write_by_month(small.commits, path)
    one = partitions.read_by_month(spark, path).where("commit_month = 202402")
    assert "PartitionFilters: [isnotnull(commit_month" in one._jdf.queryExecution().executedPlan().toString()


def test_each_file_goes_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("project_id,project_name\n1,One\n2,20\n")
    (tmp_path / "b.csv").write_text("project_name,project_id\nThree,3\n20,4\nbad\n")
    found = csv.ingest(spark, str(tmp_path), "projects")
    assert sorted((r.project_id, r.project_name) for r in found.accepted.collect()) == [(1, "One"), (2, "20"), (3, "Three"), (4, "20")]
    assert found.rejected.count() == 1 and [r.line for r in found.rejected.collect()] == ["bad"]
