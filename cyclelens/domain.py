"""The six base tables as one value handed to every plan, and the ways to obtain it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cache, cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclelens import schemas
from cyclelens.functions.scalars import id_list
from cyclelens.operators.joins import BROADCAST_ROWS, within_rows
from cyclelens.session import adapt


class Domain:
    """Base tables by name; a table given as a function is only opened when a plan first asks for it."""

    engineers: DataFrame
    teams: DataFrame
    projects: DataFrame
    repositories: DataFrame
    jira_issues: DataFrame
    commits: DataFrame

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self.spark = adapt(spark)
        self._tables = dict(tables)

    def table(self, name: str) -> DataFrame:
        if name not in schemas.SCHEMAS:
            raise ValueError(f"Unknown table: {name}")
        found = self._tables[name]
        if not isinstance(found, DataFrame):
            found = self._tables[name] = found()
        return found

    def __getattr__(self, name: str) -> DataFrame:
        if name in schemas.SCHEMAS:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def members(self) -> DataFrame:
        """(team_id, engineer_id), one row per pair, from the id list each team carries."""
        return self.teams.select(
            "team_id", F.explode(F.array_distinct(id_list("engineer_ids"))).alias("engineer_id")
        ).where(F.col("engineer_id").isNotNull())

    @cached_property
    def members_are_few(self) -> bool:
        """Whether the membership pairs were counted and found small enough to send to every executor."""
        return within_rows(self.members)

    @cached_property
    def resolved(self) -> DataFrame:
        return self.jira_issues.where(F.col("resolution_date").isNotNull())

    def having(self, **tables: DataFrame) -> Domain:
        """This domain with some of its tables exchanged."""
        changed = type(self)(self.spark, self._tables | tables)
        if "teams" not in tables:
            changed.__dict__ |= {k: v for k, v in self.__dict__.items() if k in ("members", "members_are_few")}
        return changed

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, fmt: str = "parquet") -> Domain:
        """Tables stored as `<folder>/<table>`."""
        return cls(spark, {t: partial(spark.read.format(fmt).load, f"{folder}/{t}") for t in schemas.TABLES})

    @classmethod
    def from_tables(cls, tables: Mapping[str, DataFrame]) -> Domain:
        return cls(next(iter(tables.values())).sparkSession, {t: tables[t] for t in schemas.TABLES})

    @classmethod
    def from_star(cls, spark: SparkSession, sf_dir: str) -> Domain:
        """The base tables read off an order / line-item star schema (rules in FIXTURES.md)."""
        star = cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        ordered = F.to_date("o_orderdate")

        def engineers() -> DataFrame:
            return star("supplier").select((F.col("s_suppkey") + 1).alias("id"), F.col("s_name").alias("name"))

        def teams() -> DataFrame:
            crew = F.struct((F.expr("s_suppkey div 8") * 2 + 1).alias("team_id"), F.lit("Crew ").alias("kind"))
            guild = F.struct((F.expr("(s_suppkey + 4) div 8") * 2 + 2).alias("team_id"), F.lit("Guild ").alias("kind"))
            placed = star("supplier").select("s_suppkey", F.explode(F.array(crew, guild)).alias("t"))
            # At most eight engineers per team by construction, so the id list stays short at any scale.
            ids = F.expr("listagg(CAST(s_suppkey + 1 AS STRING), ',') WITHIN GROUP (ORDER BY s_suppkey)")
            named = F.concat("kind", F.col("team_id").cast("string")).alias("team_name")
            return placed.groupBy("t.team_id", "t.kind").agg(ids.alias("engineer_ids")).select("team_id", named, "engineer_ids")

        def projects() -> DataFrame:
            key = (F.col("n_nationkey") + 1).cast("bigint")
            return star("nation").select(key.alias("project_id"), F.col("n_name").alias("project_name"))

        def repositories() -> DataFrame:
            return star("part").select(
                (F.col("p_partkey") + 1).alias("repo_id"),
                (F.col("p_partkey") % 25 + 1).alias("project_id"),
                F.col("p_name").alias("repo_name"),
            )

        def jira_issues() -> DataFrame:
            resolved = F.date_add(ordered, (F.col("o_orderkey") % 40 + 20).cast("int"))
            return star("orders").select(
                (F.col("o_orderkey") + 1).alias("issue_id"),
                (F.col("o_custkey") % 25 + 1).alias("project_id"),
                F.expr("o_custkey div 15 + 1").alias("author_id"),
                ordered.alias("creation_date"),
                F.when(F.col("o_orderstatus") != "O", resolved).alias("resolution_date"),
                F.col("o_orderpriority").alias("category"),
            )

        def commits() -> DataFrame:
            # No hint: line items and orders both grow with the data, so a skewed order is left to the adaptive split, also where
            # what follows is grouped by issue and takes over the join's partitioning (`session.adapt`). The keys are shifted before the
            # join for that, so line items are shuffled once; what only they are needed for is computed before, so few bytes move.
            orders = star("orders").select((F.col("o_orderkey") + 1).alias("_issue"), ordered.alias("_ordered"))
            items = star("lineitem").select(
                (F.col("l_orderkey") + 1).alias("jira_issue_id"),
                (F.col("l_suppkey") + 1).alias("engineer_id"),
                (F.col("l_partkey") + 1).alias("repo_id"),
                "l_linenumber",
                ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 45).cast("int").alias("_days"),
                ((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")).alias("ai_used"),
                F.col("l_quantity").cast("int").alias("lines_of_code"),
            )
            number = F.concat_ws("-", F.col("jira_issue_id") - 1, "l_linenumber", F.col("repo_id") - 1, F.col("engineer_id") - 1)
            return items.join(orders, F.col("jira_issue_id") == F.col("_issue")).select(
                number.alias("commit_id"),
                "engineer_id",
                "jira_issue_id",
                "repo_id",
                F.date_add("_ordered", F.col("_days")).alias("commit_date"),
                "ai_used",
                "lines_of_code",
            )

        makers = (engineers, teams, projects, repositories, jira_issues, commits)
        return cls(spark, {make.__name__: make for make in makers})


class StrictDomain(Domain):
    """Base tables of which a team's id list must be readable to the last id: an unreadable one fails what reads that team."""

    @cached_property
    def members(self) -> DataFrame:
        parts = F.transform(F.split("engineer_ids", ","), lambda part: F.trim(part).cast("bigint"))
        return self.teams.select("team_id", F.explode(F.array_distinct(parts)).alias("engineer_id"))

    @cached_property
    def members_are_few(self) -> bool:
        """Counted by the lists' lengths, so that no id is read."""
        return (self.teams.agg(F.sum(F.size(F.split("engineer_ids", ",")))).first()[0] or 0) <= BROADCAST_ROWS
