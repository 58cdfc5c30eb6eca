"""Streams of changed commits, issues and teams end in the state a batch run gives on the final tables."""

from datetime import date, datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclelens import schemas
from cyclelens.plans import refresh, stored_facts
from cyclelens.session import work_dir
from cyclelens.sources.buckets import BucketStore
from cyclelens.streaming import live
from tests.conftest import ROWS, as_set, make_domain

AS_OF, EARLIER = datetime(2024, 3, 1), datetime(2024, 2, 1)
D = date


class Fed:
    """Live tables of a domain, and rows that arrive."""

    def __init__(self, spark, domain, dimensions=refresh.REFRESHED):
        self.spark, self.folder = spark, work_dir(spark, "live")
        self.store = BucketStore(spark, f"{self.folder}/store")
        live.Live(domain, self.store, EARLIER, dimensions).load()
        self.live, self.dimensions = live.Live(domain, self.store, AS_OF, dimensions), dimensions

    def arrive(self, table, rows):
        schema = T.StructType([*schemas.SCHEMAS[table].fields, T.StructField("version", T.LongType())])
        path = f"{self.folder}/{table}"
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = self.spark.readStream.schema(schema).parquet(path)
        run = self.live.commits if table == "commits" else (lambda s, c: self.live.rows(table, s, c))
        run(stream, f"{self.folder}/{table}-checkpoint").awaitTermination()

    def versions(self):
        names = [refresh.table_name(d) for d in self.dimensions] + ["ai_impact_summary"]
        return {n: self.store._complete(n)[-1] for n in names}

    def check(self, domain):
        assert not self.store.exists("refresh_failures")
        for dimension in self.dimensions:
            stored = self.store.read(refresh.table_name(dimension)).drop("last_calculated")
            assert as_set(stored) == as_set(refresh.metric_rows(domain, dimension).select(stored.columns)), dimension
        whole = stored_facts.ai_impact_summary(domain, AS_OF).drop("last_updated")
        assert as_set(self.store.read("ai_impact_summary").drop("last_updated").select(whole.columns)) == as_set(whole)


def test_commits_updated_moved_repeated_and_late(spark):
    fed = Fed(spark, make_domain(spark))
    fed.arrive("commits", [
        ("a", 1, 10, 1, D(2024, 1, 9), True, 10, 1),  # the first commit of an issue is dated later
        ("d", 3, 11, 2, D(2024, 1, 8), False, 1, 1),  # moved: issue 12 has no commit left, engineer 3 still has one
        ("e", 5, 14, 2, D(2024, 1, 9), True, 2, 1),  # engineer 4 keeps one commit
        ("f", 5, 15, 2, D(2024, 2, 10), True, 3, 1),  # and now none, so the row goes; the flag flips
        ("h", 2, 13, 1, D(2024, 1, 6), True, 3, 1),
        ("h", 2, 13, 1, D(2024, 1, 5), True, 3, 2),  # two versions in one batch
    ])
    changed = {"a": (1, 10, 1, D(2024, 1, 9), True, 10), "d": (3, 11, 2, D(2024, 1, 8), False, 1), "e": (5, 14, 2, D(2024, 1, 9), True, 2), "f": (5, 15, 2, D(2024, 2, 10), True, 3), "h": (2, 13, 1, D(2024, 1, 5), True, 3)}
    final = [(c[0], *changed.get(c[0], c[1:])) for c in ROWS["commits"]] + [("h", *changed["h"])]
    domain = make_domain(spark, ROWS | {"commits": final})
    fed.check(domain)
    before = fed.versions()
    # Delivered again, an older version late, and a change that no metric depends on: nothing is written.
    fed.arrive("commits", [("a", 1, 10, 1, D(2024, 1, 9), True, 10, 1), ("h", 2, 12, 1, D(2024, 1, 6), False, 3, 1), ("b", 2, 10, 1, D(2024, 1, 6), False, 99, 7)])
    assert fed.versions() == before
    fed.check(domain)


def test_issues_changed_and_teams_follow(spark):
    fed = Fed(spark, make_domain(spark), ("team", "project"))
    old = fed.store.read(refresh.table_name("team")).where("team_id = 1").first()
    before = fed.versions()
    # An author is no column of these metrics: the stored issue follows, no metric is written.
    fed.arrive("jira_issues", [(10, 1, 3, D(2024, 1, 1), D(2024, 1, 21), "bug", 1)])
    assert fed.versions() == before and fed.store.read("jira_issues").where("issue_id = 10").first().author_id == 3
    fed.arrive("jira_issues", [(10, 1, 3, D(2024, 1, 1), D(2024, 2, 21), "bug", 3), (14, 1, 3, D(2024, 1, 5), D(2024, 1, 30), "docs", 2), (16, 3, 1, D(2024, 1, 5), None, "new", 1)])
    changes = {10: (1, 3, D(2024, 1, 1), D(2024, 2, 21), "bug"), 14: (1, 3, D(2024, 1, 5), D(2024, 1, 30), "docs")}
    issues = [(i[0], *changes.get(i[0], i[1:])) for i in ROWS["jira_issues"]] + [(16, 3, 1, D(2024, 1, 5), None, "new")]
    fed.check(make_domain(spark, ROWS | {"jira_issues": issues}))
    team = fed.store.read(refresh.table_name("team"))
    assert team.where("team_id = 1").first() != old
    # Team 3 has nothing to do with these issues.
    assert [r.team_id for r in team.where(F.col("last_calculated") == F.lit("2024-02-01").cast("timestamp_ntz")).collect()] == [3]
    before = fed.versions()
    fed.arrive("jira_issues", [(10, 2, 3, D(2024, 1, 1), None, "bug", 2)])  # older than what is stored
    assert fed.versions() == before


def test_teams_changed(spark):
    fed = Fed(spark, make_domain(spark), ("team",))
    fed.arrive("teams", [(3, "Idle", "4,2", 1), (1, "Core", "1", 1)])
    teams = [(1, "Core", "1"), (2, "Edge", "3,1"), (3, "Idle", "4,2")]
    fed.check(make_domain(spark, ROWS | {"teams": teams}))
    before = fed.versions()
    fed.arrive("teams", [(2, "Border", "3,1", 2)])
    assert fed.versions() == before and fed.store.read("teams").where("team_id = 2").first().team_name == "Border"


def test_a_read_asks_no_base_table(spark):
    """Base tables that fail as soon as they are read: neither a fresh nor an outdated read touches them."""
    domain = make_domain(spark)
    store = BucketStore(spark, work_dir(spark, "live"))
    kept = live.Live(domain, store, EARLIER, ("team",))
    kept.load()
    lost = {t: domain.table(t).withColumn(domain.table(t).columns[0], F.raise_error(F.lit("read")).cast(domain.table(t).schema[0].dataType)) for t in schemas.TABLES}
    kept.base = domain.having(**lost)
    before = store._complete(refresh.table_name("team"))
    fresh = kept.current("team", datetime(2024, 2, 1, 12))
    assert store._complete(refresh.table_name("team")) == before and fresh.count() == 3
    assert all(f.startswith(f"file:{store.root}") or store.root in f for f in fresh.inputFiles())
    # One team is refreshed by itself, then the others.
    one = kept.current("team", AS_OF, entity=2).collect()
    assert [(r.team_id, r.last_calculated) for r in one] == [(2, AS_OF)]
    assert sorted((r.team_id, r.last_calculated) for r in store.read(refresh.table_name("team")).collect()) == [(1, EARLIER), (2, AS_OF), (3, EARLIER)]
    rows = kept.current("team", AS_OF)
    assert as_set(rows.drop("last_calculated")) == as_set(refresh.metric_rows(domain, "team").select(rows.drop("last_calculated").columns))


def test_daily_counts_add_up_to_nothing(spark):
    rows = [(1, 1, D(2024, 1, 1), 1, 1), (1, 1, D(2024, 1, 1), -1, -1), (1, 1, D(2024, 1, 2), 1, 0), (1, None, D(2024, 1, 2), 1, 0)]
    daily = live.daily_counts(spark.createDataFrame(rows, live.SIGNED))
    assert sorted(map(str, daily.collect())) == sorted(map(str, daily.where("day = DATE '2024-01-02'").collect()))
    assert [tuple(r) for r in live.rollup_of(daily).collect()] == [(1, 1, D(2024, 1, 2), D(2024, 1, 2), 1, 0)]
