"""How often the commits are moved: once from the base tables to the measures of an issue."""

import re

from pyspark.sql import functions as F

from cyclelens.domain import Domain
from cyclelens.operators.facts import contributions, regroup
from tests.conftest import as_set
from tests.test_scale import executed, no_broadcast  # noqa: F401


def star_of(spark, folder):
    """An order / line-item schema of a few rows, with missing keys and repeated rows."""
    orders = [(k, k % 7, f"1995-01-{k % 28 + 1:02d}", "F" if k % 3 else "O", "1-URGENT") for k in range(60)] + [(5, 5, "1995-01-06", "F", "1-URGENT"), (None, 1, "1995-01-01", "F", "x")]
    items = [(k % 60, k % 11, k % 4 if k % 13 else None, k % 3, "A" if k % 2 else "N", "F", 3.0) for k in range(300)] + [(None, 1, 1, 1, "A", "F", 1.0), (4, 4, 0, 1, "A", "F", 3.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string, o_orderstatus string, o_orderpriority string").withColumn("o_orderdate", F.to_date("o_orderdate")).write.parquet(f"{folder}/orders.parquet")
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double"
    spark.createDataFrame(items, kind).write.parquet(f"{folder}/lineitem.parquet")
    return Domain.from_star(spark, str(folder))


def test_line_items_are_shuffled_once(spark, tmp_path, no_broadcast):  # noqa: F811
    star = star_of(spark, tmp_path)
    plan = executed(regroup(contributions(star), "engineer_id", carry=("project_id",)))
    # Line items, orders as their dates, orders as issues; neither the rollup nor what follows is shuffled again.
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 3


def test_commits_are_as_before(spark, tmp_path):
    star = star_of(spark, tmp_path)
    items, orders = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("lineitem", "orders"))
    days = ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 45).cast("int")
    expected = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("commit_id"), (F.col("l_suppkey") + 1).alias("engineer_id"), (F.col("l_orderkey") + 1).alias("jira_issue_id"),
        (F.col("l_partkey") + 1).alias("repo_id"), F.date_add("o_orderdate", days).alias("commit_date"), ((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")).alias("ai_used"), F.col("l_quantity").cast("int").alias("lines_of_code"),
    )
    assert star.commits.dtypes == expected.dtypes
    assert as_set(star.commits) == as_set(expected)
