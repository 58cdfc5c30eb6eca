"""What the plans must look like when tables are large or keys are skewed."""

import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cyclelens.domain import Domain
from cyclelens.operators import joins
from cyclelens.operators.facts import by_team, contributions, team_fact
from cyclelens.plans import cross, rollups, stored_facts, timeline
from tests.conftest import SF, as_set

AS_OF = datetime(2024, 3, 1)


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shuffled_join_gives_the_same_rows(star):
    facts = contributions(star)
    for how in ("inner", "left"):
        small = joins.lookup_join(facts, star.members, "engineer_id", how, small=True)
        shuffled = joins.lookup_join(facts, star.members, "engineer_id", how, small=False)
        assert as_set(small) == as_set(shuffled.select(*small.columns))


def test_shuffled_semi_join_gives_the_same_rows(star):
    keys = star.members.where("team_id = 1").select("engineer_id")
    small = joins.lookup_join(star.commits, keys, "engineer_id", "left_semi", small=True)
    shuffled = joins.lookup_join(star.commits, keys, "engineer_id", "left_semi", small=False)
    assert as_set(small) == as_set(shuffled.select(*small.columns))


def test_large_lookup_is_not_broadcast(spark, star, no_broadcast):
    big = Domain.from_star(spark, SF)
    big.__dict__["members_are_few"] = False
    fact = team_fact(big)
    assert "BroadcastHashJoin" not in executed(fact)
    assert as_set(rollups.team_metrics(big)) == as_set(rollups.team_metrics(star))


def test_size_check_counts(spark):
    assert joins.within_rows(spark.range(10), 10) and not joins.within_rows(spark.range(11), 10)


def test_large_lookup_is_not_multiplied(spark, star, no_broadcast):
    """No row of a large lookup is repeated before the shuffle."""
    joined = joins.lookup_join(contributions(star), star.members, "engineer_id", small=False)
    plan = executed(joined)
    assert "explode(sequence" not in plan.lower() and "SinglePartition" not in plan


def test_skewed_line_items_are_split_at_run_time(spark, no_broadcast, tmp_path):
    """A third of the line items on one order: the base join is split, and the metrics do not change."""
    import shutil

    for name in ("supplier", "orders", "nation", "part"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    tripled = items.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(29))))
    skewed = tripled.withColumn("l_orderkey", F.when(F.col("i") < 10, 7).otherwise(F.col("l_orderkey"))).drop("i")
    skewed.repartition(16).write.parquet(str(tmp_path / "lineitem.parquet"))
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    skewed_domain = Domain.from_star(spark, str(tmp_path))
    whole = as_set(rollups.engineer_metrics_scored(skewed_domain))
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        plan = executed(rollups.engineer_metrics_scored(skewed_domain))
        split = as_set(rollups.engineer_metrics_scored(skewed_domain))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "skew=true" in plan
    assert split == whole


def test_pairs_read_the_commits_once(star, no_broadcast):
    plan = executed(cross.cross_dimensional(star))
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) == 1
    assert "ReusedExchange" in plan


SKEW = {
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.mark.parametrize(
    "plan_of",
    [
        rollups.team_metrics,
        cross.cross_dimensional,
        stored_facts.ai_impact_base,
        lambda d: stored_facts.ai_impact_summary(d, AS_OF),
        lambda d: stored_facts.summary_delta(d, stored_facts.changed_since(d, date(1999, 1, 1)), AS_OF),
    ],
    ids=["team_metrics", "cross_dimensional", "ai_impact_base", "ai_impact_summary", "summary_delta"],
)
def test_a_hot_issue_is_split(spark, no_broadcast, plan_of):
    """A third of the commits, by very many engineers, on one issue: its join is split, and results do not change."""
    star = Domain.from_star(spark, SF)
    people = spark.range(1, 30_001)
    engineers = people.select("id", F.lit("E").alias("name"))
    hot = people.select(
        F.concat(F.lit("h"), F.col("id").cast("string")).alias("commit_id"),
        F.col("id").alias("engineer_id"),
        F.lit(8).cast("long").alias("jira_issue_id"),
        F.lit(1).cast("long").alias("repo_id"),
        F.lit(date(2000, 1, 1)).alias("commit_date"),
        F.lit(True).alias("ai_used"),
        F.lit(1).alias("lines_of_code"),
    )
    issues = star.jira_issues.withColumn("resolution_date", F.coalesce("resolution_date", F.lit(date(2001, 1, 1))))
    commits = star.commits.unionByName(hot.select(star.commits.columns))
    crowd = star.having(commits=commits, jira_issues=issues, engineers=engineers)
    crowd.__dict__["members_are_few"] = True
    whole = as_set(plan_of(crowd))
    before = {k: spark.conf.get(k) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    try:
        plan = executed(plan_of(crowd))
        split = as_set(plan_of(crowd))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "skew=true" in plan
    assert split == whole


def test_top_k_is_limited_before_the_shuffle(spark, star):
    from datetime import date

    plan = executed(timeline.top_repositories(star, date(2001, 12, 31)))
    assert plan.count("WindowGroupLimit") == 2


def test_no_cartesian_or_nested_loop_joins(star, no_broadcast):
    from datetime import date

    frames = (
        cross.cross_dimensional(star),
        timeline.timeline_periods(star, date(2001, 12, 31)),
        rollups.team_metrics(star),
        by_team(star, contributions(star), "left"),
    )
    for frame in frames:
        plan = executed(frame)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_only_needed_columns_are_read(star, no_broadcast):
    plan = executed(rollups.team_metrics(star))
    assert "o_orderpriority" not in plan and "l_quantity" not in plan


def test_keyed_refresh_cuts_its_input_before_the_aggregates(star, no_broadcast):
    from cyclelens.plans import refresh

    for dimension in refresh.KEYS:
        keys = refresh.owners(star, dimension).orderBy(refresh.KEYS[dimension]).limit(2)
        cut, rolled = refresh.restrict(star, dimension, keys)
        some = refresh.metric_rows(cut, dimension, rolled)
        everything = refresh.metric_rows(star, dimension).join(keys, refresh.KEYS[dimension], "left_semi")
        assert as_set(some) == as_set(everything)
        plan = some._jdf.queryExecution().optimizedPlan().toString()
        grain = "engineer_id" if dimension == "team" else refresh.KEYS[dimension]
        semi = re.search(rf"LeftSemi, \({grain}#", plan)
        assert plan.index("issues_with_ai") < semi.start()


def test_first_day_reads_one_month_folder(spark, small, tmp_path):
    from cyclelens.operators import partitions, periods

    partitions.write_by_month(small.commits, str(tmp_path / "c"))
    stored = partitions.read_by_month(spark, str(tmp_path / "c"))
    assert periods.first_day(stored) == periods.first_day(small.commits)
