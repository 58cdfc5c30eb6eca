"""Dimensions refreshed together start from tallies made in one go."""

import re

from pyspark.sql import functions as F

from cyclelens.domain import StrictDomain
from cyclelens.operators.facts import engineer_rollup
from cyclelens.plans import refresh
from cyclelens.session import work_dir
from cyclelens.sources.storage import TableStore
from tests.conftest import ROWS, as_set, make_domain
from tests.test_scale import executed, no_broadcast  # noqa: F401
from tests.test_shuffles import star_of


def _odd(spark, folder):
    """Tables with rows that come twice, and with nulls in keys."""
    star = star_of(spark, folder)
    teams = spark.createDataFrame([(1, "A", "1,2,3"), (2, "B", "3, 4,x"), (3, "C", None), (4, "D", "4")], "team_id long, team_name string, engineer_ids string")
    issues = star.jira_issues.withColumn("project_id", F.when(F.col("issue_id") % 5 > 0, F.col("project_id")))
    issues = issues.unionByName(issues.where("issue_id % 4 = 0")).unionByName(issues.where("issue_id = 9").withColumn("project_id", F.lit(77).cast("long")))
    return star.having(teams=teams, jira_issues=issues)


def test_tallies_give_the_rows_of_each_dimension(spark, tmp_path):
    domain = _odd(spark, tmp_path)
    rolled = engineer_rollup(domain)
    store = TableStore(spark, work_dir(spark, "tallies"))
    for parts in (None, rolled.unionByName(rolled.where("false")).withColumn("_n", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({c: F.when(F.col("_n") == 0, F.col(c)).otherwise(F.lit(0)) for c in ("total_commits", "ai_commits")}).drop("_n")):
        shared = refresh.share(domain, store, dict.fromkeys(refresh.KEYS), rolled, parts, last=True)
        assert isinstance(shared, refresh.Tallied) and set(shared.dimensions) == set(refresh.KEYS)
        touched, before = refresh.last_touched(domain, shared), refresh.last_touched(domain, rolled)
        for dimension, key in refresh.KEYS.items():
            expected = refresh.metric_rows(domain, dimension, rolled)
            got = refresh.metric_rows(domain, dimension, shared)
            assert got.dtypes == expected.dtypes and as_set(got) == as_set(expected), dimension
            assert as_set(touched[dimension].where(F.col(key).isNotNull())) == as_set(before[dimension].where(F.col(key).isNotNull())), dimension


def test_few_due_entities_are_not_shared(spark, tmp_path):
    domain = _odd(spark, tmp_path)
    store = TableStore(spark, work_dir(spark, "tallies"))
    rolled = engineer_rollup(domain)
    from tests.test_live import AS_OF

    for dimension in refresh.REFRESHED:
        refresh.refresh(domain, store, dimension, AS_OF, None, rolled)
    few = {"team": spark.createDataFrame([(1,)], "team_id long"), "engineer": spark.createDataFrame([(1,)], "engineer_id long")}
    assert refresh.share(domain, store, few, rolled) is rolled
    most = refresh.share(domain, store, few | {"project": None, "category": domain.jira_issues.select("category").distinct()}, rolled)
    assert most.dimensions == ("project", "category")


def test_unreadable_members_fail_the_teams_alone(spark):
    from tests.test_live import AS_OF

    rows = ROWS | {"teams": [(1, "Core", "1, 2"), (2, "Edge", "3,x1")]}
    strict = StrictDomain(spark, make_domain(spark, rows)._tables)
    store = TableStore(spark, work_dir(spark, "tallies"))
    assert set(refresh.refresh_all(strict, store, AS_OF)) == {"engineer", "project", "category"}
    assert {r.dimension for r in store.read("refresh_failures").collect()} == {"team"}


def test_the_rollup_is_shuffled_once_for_all_dimensions(spark, tmp_path, no_broadcast):  # noqa: F811
    domain = _odd(spark, tmp_path)
    domain.__dict__["members_are_few"] = True
    stored = TableStore(spark, work_dir(spark, "tallies")).replace("rolled", engineer_rollup(domain))
    plan = executed(refresh.tallies(domain, stored, tuple(refresh.KEYS)))
    # The rollup and the issues by issue; the members by engineer; the tallies by entity.
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 4
    assert len(re.findall(r"Exchange hashpartitioning\(issue_id", plan)) == 2
