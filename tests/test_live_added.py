"""Rows added to dealt tables beside what they replace, and one shuffle from what is stored to what is stored next."""

import re
from datetime import date as D
from functools import reduce

import pytest
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclelens import catalog
from cyclelens.operators.facts import engineer_rollup
from cyclelens.plans import refresh, stored_facts
from cyclelens.session import CLEANUP, release, work_dir
from cyclelens.sources.buckets import RUNS, BucketStore
from cyclelens.streaming import live
from tests.conftest import ROWS, as_set, make_domain
from tests.test_live import AS_OF, Fed
from tests.test_scale import executed, no_broadcast  # noqa: F401
from tests.test_shuffles import star_of
from tests.test_tallies import _odd

LAST = "commit_id string, version long, issue_id long, engineer_id long, day date, ai boolean"


def versions(spark, n, version):
    return spark.range(n).select(F.col("id").alias("k"), F.lit(version).alias("n"), F.lit(None).cast("long").alias("v"))


def test_the_greatest_added_row_stands(spark):
    store = BucketStore(spark, work_dir(spark, "added"), bucket_rows=10)
    store.deal("t", versions(spark, 40, 0), "k")
    old = {r["path"] for r in store._list("t")["files"]}
    store.add("t", versions(spark, 5, 2).withColumn("why", F.lit("late")), ("n", "v"), tag=1)
    store.add("t", versions(spark, 3, 1).withColumn("why", F.lit("early")), ("n", "v"), tag=2)
    assert store.tag("t") == 2 and old < {r["path"] for r in store._list("t")["files"]}
    assert sorted(tuple(r) for r in store.added("t").collect()) == [(k, 1, None, "early") for k in range(3)]
    stands = sorted((k, 2 if k < 5 else 0) for k in range(40))
    assert store.read("t").columns == ["k", "n", "v"] and sorted((r.k, r.n) for r in store.read("t").collect()) == stands
    assert [(r.k, r.n) for r in store.lookup("t", spark.createDataFrame([(1,)], "k long")).collect()] == [(1, 2)]
    # A keyed write merges the buckets it touches, and the others stay as they are.
    store.modify("t", spark.createDataFrame([(1,)], "k long"), "k", lambda rows, _: rows.where("k <> 1"))
    assert sorted((r.k, r.n) for r in store.read("t").collect()) == [s for s in stands if s[0] != 1]


def test_files_of_a_bucket_are_merged(spark):
    store = BucketStore(spark, work_dir(spark, "added"), bucket_rows=100)
    store.deal("t", versions(spark, 40, 0), "k")
    for n in range(1, RUNS + 1):
        store.compact("t")
        assert len(store._list("t")["files"]) == n
        store.add("t", versions(spark, 2, n), ("n", "v"), tag=n)
    store.compact("t")
    assert len(store._list("t")["files"]) == 1 and store.tag("t") == RUNS
    store.expire("t", keep=1)
    assert sorted((r.k, r.n) for r in store.read("t").collect()) == sorted((k, RUNS if k < 2 else 0) for k in range(40))
    # More rows than four times what the buckets are for: dealt anew.
    for n in range(1, 12):
        store.add("t", versions(spark, 40, RUNS + n), ("n", "v"))
    store.compact("t")
    assert sum(r["rows"] for r in store._list("t")["files"]) == 40


def test_new_versions_take_one_shuffle(spark):
    before = spark.createDataFrame([("a", 1, 1, 1, D(2024, 1, 1), True), ("a", 0, 9, 9, D(2024, 1, 1), True), ("b", 2, 1, None, None, False)], LAST)
    batch = spark.createDataFrame([("a", 2, 1, 1, D(2024, 1, 2), True), ("a", 2, 1, 1, D(2024, 1, 3), None), ("b", 2, 9, 9, D(2024, 1, 9), True), ("c", 0, None, 1, D(2024, 1, 1), True)], LAST)
    found = live.newer(before, batch, 4)
    assert len(re.findall(r"Exchange hashpartitioning", executed(found))) == 1
    rows = {r.commit_id: (r.version, r.day, r.old_version, r.old_issue_id) for r in found.collect()}
    assert rows == {"a": (2, D(2024, 1, 3), 1, 1), "c": (0, D(2024, 1, 1), None, None)}


def test_last_versions_are_added_and_not_written_again(spark):
    domain = make_domain(spark)
    fed = Fed(spark, domain, ("project",))
    fed.arrive("commits", [("a", 1, 10, 1, D(2024, 1, 9), True, 10, 1)])
    files = fed.store._list("commits_last")["files"]
    fed.arrive("commits", [("a", 1, 10, 1, D(2024, 1, 8), True, 10, 2)])
    assert {r["path"] for r in files} < {r["path"] for r in fed.store._list("commits_last")["files"]}
    assert fed.store.added("commits_last").count() == 1 and fed.store.read("commits_last").count() == len(ROWS["commits"])
    # A batch that is run again finds what it added.
    again = fed.store.added("commits_last").first()
    assert (again.version, again.old_version, again.old_day) == (2, 1, D(2024, 1, 9))


def test_commits_named_apart_are_as_before(spark, tmp_path):
    star = star_of(spark, tmp_path)
    nth = F.row_number().over(Window.partitionBy("commit_id").orderBy("commit_date", "ai_used", "lines_of_code"))
    whole = star.commits.withColumn("nth", nth)
    before = whole.withColumn("commit_id", F.when(F.col("nth") == 1, F.col("commit_id")).otherwise(F.concat_ws("#", "commit_id", "nth"))).drop("nth")
    now = catalog._named_apart(star)
    assert as_set(now) == as_set(before) and now.where("commit_id LIKE '%#%'").count() > 0


def daily(spark, rows):
    return spark.createDataFrame(rows, live.SIGNED)


def test_added_rows_are_summed_up(spark):
    store = BucketStore(spark, work_dir(spark, "added"), bucket_rows=2)
    first = [(i, 1, D(2024, 1, 1), 1, 1) for i in range(6)] + [(None, None, None, 1, 0)]
    store.deal("d", live.daily_dealt(daily(spark, first), 3), "issue_id", 3)
    store.add("d", live.daily_dealt(daily(spark, [(0, 1, D(2024, 1, 1), -1, -1), (1, 1, D(2024, 1, 1), 1, 0), (9, 9, D(2024, 1, 1), 1, 0)]), 3), sums=("commits", "ai"), tag=4)
    left = sorted(map(str, daily(spark, [(1, 1, D(2024, 1, 1), 2, 1), *[r for r in first[2:]], (9, 9, D(2024, 1, 1), 1, 0)]).collect()))
    assert sorted(map(str, store.read("d").collect())) == left and store.read("d", every=True).count() == 10
    assert store.added("d").count() == 3 and store.tag("d") == 4
    store.compact("d", 1)
    assert sorted(map(str, store.read("d", every=True).collect())) == left and store.tag("d") == 4


def test_daily_counts_are_dealt_by_one_shuffle(spark):
    found = live.daily_dealt(daily(spark, [(1, 1, D(2024, 1, 1), 1, 0), (1, 1, D(2024, 1, 1), 1, 1), (2, 1, None, 1, 0), (2, 1, None, -1, 0)]), 4)
    assert len(re.findall(r"Exchange hashpartitioning", executed(found))) == 1
    assert [tuple(r) for r in found.drop("__bucket").collect()] == [(1, 1, D(2024, 1, 1), 2, 1)]


@pytest.mark.parametrize("many", [0, 10**9])
def test_small_and_large_batches_give_the_same(spark, monkeypatch, many):
    """Daily counts merged into their buckets, or added beside the old ones; and one kind after the other."""
    monkeypatch.setattr(live, "MANY", many)
    fed = Fed(spark, make_domain(spark))
    fed.arrive("commits", [("a", 1, 10, 1, D(2024, 1, 9), True, 10, 1), ("f", 5, 15, 2, D(2024, 2, 10), True, 3, 1)])
    assert ("merge" in fed.store._list("daily")) is (many > 0)
    monkeypatch.setattr(live, "MANY", 10**9 - many)
    fed.arrive("commits", [("d", 3, 11, 2, D(2024, 1, 8), False, 1, 1), ("a", 1, 10, 1, D(2024, 1, 7), True, 10, 2)])
    changed = {"a": (1, 10, 1, D(2024, 1, 7), True, 10), "d": (3, 11, 2, D(2024, 1, 8), False, 1), "f": (5, 15, 2, D(2024, 2, 10), True, 3)}
    fed.check(make_domain(spark, ROWS | {"commits": [(c[0], *changed.get(c[0], c[1:])) for c in ROWS["commits"]]}))


def test_the_summary_and_the_tallies_share_their_shuffles(spark, tmp_path, no_broadcast):  # noqa: F811
    odd = _odd(spark, tmp_path)
    store = BucketStore(spark, work_dir(spark, "added"))
    star = odd.having(jira_issues=store.replace("jira_issues", odd.jira_issues), teams=store.replace("teams", odd.teams))
    star.__dict__["members_are_few"] = True
    # Signed rows of one commit date each: some that come to nothing, and those that are left.
    rolled = store.replace("rolled", engineer_rollup(star))
    gone = rolled.where("issue_id % 5 = 0")
    each = [rolled, gone, gone.withColumns({c: -F.col(c) for c in ("total_commits", "ai_commits")})]
    signed = store.replace("signed", reduce(DataFrame.unionByName, each))
    plans = []
    store.replace = lambda name, df: (plans.append(executed(df)), BucketStore.replace(store, name, df))[1]
    summary = lambda joined: stored_facts.ai_impact_summary(star, AS_OF, joined=joined)
    shared = refresh.share(star, store, dict.fromkeys(refresh.REFRESHED), rolled, signed, signed=True, along=summary)
    shuffles = [line for line in plans[0].splitlines() if "Exchange hashpartitioning(issue_id" in line]
    assert sorted("ReusedExchange" in line for line in shuffles) == [False, False, True, True]
    assert as_set(shared.along) == as_set(stored_facts.ai_impact_summary(star, AS_OF, rolled)) and not shared.along.isEmpty()
    for dimension in refresh.REFRESHED:
        expected = refresh.metric_rows(star, dimension, rolled)
        assert as_set(refresh.metric_rows(star, dimension, shared)) == as_set(expected), dimension


def test_a_whole_summary_keeps_the_time_of_what_did_not_change(spark):
    fed = Fed(spark, make_domain(spark))
    before = {r.issue_id: r.last_updated for r in fed.store.read("ai_impact_summary").collect()}
    arrived = [(c[0], c[1], c[2], c[3], c[4], not c[5], c[6], 1) for c in ROWS["commits"] if c[2] != 12]
    fed.arrive("commits", arrived)
    assert fed.store._list("ai_impact_summary") is None
    after = {r.issue_id: r.last_updated for r in fed.store.read("ai_impact_summary").collect()}
    assert set(after) == set(before) and {k for k in after if after[k] == before[k]} == {12}


def test_a_frame_is_run_again_after_its_shuffles_went(spark):
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        rows = release(spark).range(100).groupBy((F.col("id") % 7).alias("k")).count()
        assert rows.collect() == rows.collect() and rows.count() == 7
    finally:
        spark.conf.set(CLEANUP, before)


def test_ids_are_packed_and_unpacked(spark):
    ids = ["12-3-4", "1-3-4", "-", "--", "0", "00", "000", "-5--3", "", "a", "ab", "abc", "0a", "f", "ff", "F0", "0A", "12\n", "ab\n", "é-1", "12-3#2", "00ff00", "A-1", None, "da39a3ee5e6b4b0d3255bfef95601890afd80709"]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select("id", live.packed("id").alias("p"))
    found = rows.select("id", "p", live.unpacked("p").alias("back")).collect()
    assert [r.back for r in found] == ids and len({bytes(r.p) for r in found if r.p is not None}) == len(ids) - 1
    assert [len(found[i].p) for i in (0, 1, -1)] == [4, 3, 21]
