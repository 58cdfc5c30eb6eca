"""Every query by name, as run on the star-schema tables of FIXTURES.md. Each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cyclelens import schemas
from cyclelens.domain import Domain, StrictDomain
from cyclelens.functions import scalars as fx
from cyclelens.functions import sql as sql_functions
from cyclelens.operators import partitions, periods, quality, ranking
from cyclelens.operators.facts import contributions, engineer_rollup, issue_fact
from cyclelens.operators.merge import changed_rows
from cyclelens.operators.ranking import page
from cyclelens.operators.summarize import SUMMARY
from cyclelens.plans import cross, cycle_time, dashboard, impact, refresh, rollups, stored_facts, timeline
from cyclelens.plans.high_water import ImpactTables
from cyclelens.session import work_dir
from cyclelens.sources import csv as csv_source
from cyclelens.sources import tables
from cyclelens.sources.buckets import CODEC, BucketStore
from cyclelens.sources.load_set import LoadSets
from cyclelens.sources.storage import TableStore
from cyclelens.streaming import refresh as streams
from cyclelens.streaming.live import Live

# Injected instead of the wall clock, so that results can be compared.
AS_OF = datetime(2001, 12, 31)
END = AS_OF.date()
# Stored tables start from the commits up to this day; later ones arrive as changes.
MARK = date(2000, 12, 31)
MARK_TIME = datetime(2000, 12, 31)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(name: str | None = None):
    """Registers a plan over the domain tables under its own or the given name."""

    def register(plan: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        QUERIES[name or plan.__name__] = lambda spark, sf_dir: plan(Domain.from_star(spark, sf_dir))
        return plan

    return register


def _star_query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _until(d: Domain, day: date) -> Domain:
    return d.having(commits=d.commits.where(F.col("commit_date") <= F.lit(day)))


def _store(d: Domain, label: str) -> TableStore:
    return TableStore(d.spark, work_dir(d.spark, label))


def _text_list(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",", "NULL")


# -- core -------------------------------------------------------------------------------------------------------------

FACT = tuple(c for c in stored_facts.FACT if c != "team_ids")

_query("issue_fact")(lambda d: issue_fact(d).select(*FACT, "first_commit_date"))
_query("ai_impact")(impact.ai_impact)
_query("ai_impact_of_project")(lambda d: impact.ai_impact(d, project=1))
_query("ai_impact_of_author")(lambda d: impact.ai_impact(d, author=1))
_query("ai_impact_of_engineer")(lambda d: impact.ai_impact(d, engineer=1))
_query("ai_impact_of_team")(lambda d: impact.ai_impact(d, team=1))
_query("category_stats")(lambda d: impact.category_stats(issue_fact(d)))
_query("issue_detail")(lambda d: impact.issue_detail(contributions(d), "engineer_id"))


@_query()
def issue_detail_pages(d: Domain) -> DataFrame:
    pages = impact.issue_detail_pages(issue_fact(d), "project_id")
    ids = F.array_join(F.transform("issues", lambda i: i["issueId"].cast("string")), ",")
    days = F.aggregate("issues", F.lit(0).cast("bigint"), lambda total, i: total + i["cycleTime"])
    return pages.select("project_id", "has_ai_commits", "page", ids.alias("issue_ids"), days.alias("cycle_days"))


_query("team_metrics")(rollups.team_metrics)
_query("engineer_metrics")(rollups.engineer_metrics)
_query("project_metrics")(rollups.project_metrics)
_query("top_categories")(rollups.top_categories)


@_query()
def impact_document(d: Domain) -> DataFrame:
    """The nested document, its two category maps unfolded to rows."""
    document = impact.impact_document(issue_fact(d))
    sides = [
        document.select("summary.*", F.lit(flag).alias("has_ai_commits"), F.explode(f"detailedStats.{name}").alias("category", "c"))
        for flag, name in ((True, "categoriesWithAi"), (False, "categoriesWithoutAi"))
    ]
    return sides[0].unionByName(sides[1]).select(
        "totalIssuesAnalyzed", "cycleTimeImpactPercentage", "has_ai_commits", "category", "c.*"
    )


@_query()
def team_metrics_materialized(d: Domain) -> DataFrame:
    table = rollups.team_metrics_materialized(d, _store(d, "team_metrics"), AS_OF)
    stored = rollups.team_metrics_with_info(table, d.teams)
    shown = F.transform("top_categories", lambda c: F.concat_ws(":", c["category"], c["issueCount"].cast("string")))
    return stored.withColumn("top_categories", F.array_join(shown, ","))


@_query()
def team_metrics_with_categories(d: Domain) -> DataFrame:
    stored = rollups.team_metrics_materialized(d, _store(d, "team_categories"), AS_OF).drop("last_calculated")
    exploded = stored.select("team_id", *SUMMARY, "ai_adoption_rate", F.posexplode_outer("top_categories").alias("pos", "c"))
    return exploded.select(
        "team_id",
        *SUMMARY,
        "ai_adoption_rate",
        (F.col("pos") + 1).alias("rank"),
        F.col("c.category").alias("category"),
        F.col("c.issueCount").alias("issue_count"),
        F.col("c.aiPercentage").alias("ai_percentage"),
    )


_query("engineer_metrics_scored")(rollups.engineer_metrics_scored)


@_query()
def engineer_metrics_page(d: Domain) -> DataFrame:
    return rollups.engineer_metrics_page(d, batch=25, offset=50).select("engineer_id", "engineer_name", "metrics.*")


_query("project_metrics_materialized")(lambda d: rollups.project_metrics_materialized(d, AS_OF))
_query("author_metrics")(rollups.author_metrics)
_query("author_metrics_as_engineer")(lambda d: rollups.author_metrics(d, match="engineer"))
_query("category_metrics")(rollups.category_metrics)
_query("author_page")(lambda d: page(rollups.author_metrics(d), "author_id", limit=20, offset=10))

# -- cycle time -------------------------------------------------------------------------------------------------------

_query("issue_cycle_time")(cycle_time.issue_cycle_time)
_query("all_issue_cycle_times")(cycle_time.all_issue_cycle_times)
_query("average_cycle_time")(lambda d: cycle_time.average_cycle_time(cycle_time.all_issue_cycle_times(d)))
_query("cycle_time_summary")(cycle_time.cycle_time_summary)
_query("first_commit")(cycle_time.first_commit)

# -- time -------------------------------------------------------------------------------------------------------------

_query("timeline_adoption")(timeline.timeline_adoption)
_query("timeline_periods")(lambda d: timeline.timeline_periods(d, END))
_query("timeline_periods_weekly")(lambda d: timeline.timeline_periods(d, END, interval="week"))
_query("timeline_top_categories")(lambda d: timeline.timeline_top_categories(d, END))
_query("top_repositories")(lambda d: timeline.top_repositories(d, END))
_query("timeline_commit_volume")(lambda d: timeline.timeline_commit_volume(d, END))
_query("timeline_creation_to_resolution")(lambda d: timeline.timeline_creation_to_resolution(d, END))


@_query()
def timeline_read(d: Domain) -> DataFrame:
    store = _store(d, "timeline_read")
    timeline.timeline_current(d, store, AS_OF)
    rows = timeline.timeline_current(d, store, AS_OF, start=date(1998, 1, 1), end=date(1999, 12, 31))
    return rows.select(
        "time_period",
        "period_end",
        "interval",
        *timeline.PERIOD,
        *timeline.PERIOD_AVERAGES,
        F.size("top_categories").alias("category_count"),
        F.element_at("top_repositories", 1)["repoId"].alias("busiest_repo"),
    )


@_query()
def timeline_read_weekly(d: Domain) -> DataFrame:
    """Weeks read from the table that holds the months too."""
    store = _store(d, "timeline_read_weekly")
    timeline.timeline_current(d, store, AS_OF)
    rows = timeline.timeline_current(d, store, AS_OF, interval="week")
    return rows.select("time_period", *timeline.PERIOD, *timeline.PERIOD_AVERAGES)


@_query()
def period_table(d: Domain) -> DataFrame:
    return periods.period_table(d.spark, periods.first_day(d.commits), END)


# -- pairs and routing ------------------------------------------------------------------------------------------------

_query("cross_dimensional")(cross.cross_dimensional)


@_query()
def cross_dimensional_lookup(d: Domain) -> DataFrame:
    store = _store(d, "cross_dimensional_lookup")
    before = cross.cross_dimensional(_until(d, MARK)).withColumn("last_calculated", fx.instant(MARK_TIME))
    stored = store.replace("cross_dimensional_metrics", before)
    row, recomputed = cross.cross_dimensional_lookup(d, stored, "team-project", 1, 1, AS_OF)
    if recomputed:
        stored = store.upsert("cross_dimensional_metrics", row, "dimension_key")
    return stored.where(F.col("dimension_key") == "team-project:1:1")


@_star_query
def cross_dimensional_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (
        F.when(F.col("c_mktsegment") == "BUILDING", "team-project")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "engineer-project")
        .when(F.col("c_mktsegment") == "MACHINERY", "author-project")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "team-engineer")
        .otherwise("team-category")
    )
    requests = (
        spark.read.parquet(f"{sf_dir}/customer.parquet")
        .select(
            kind.alias("dimension_type"),
            F.col("c_custkey").alias("primary_id"),
            F.col("c_nationkey").cast("bigint").alias("secondary_id"),
        )
    )
    return cross.cross_dimensional_checked(Domain.from_star(spark, sf_dir), requests)


@_star_query
def metric_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment, entity, place = F.col("c_mktsegment"), F.col("c_custkey") + 1, (F.col("c_nationkey") + 1).cast("bigint")
    filters = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("request_id"),
        F.when(segment.isin("BUILDING", "HOUSEHOLD"), place).alias("team_id"),
        F.when(segment != "HOUSEHOLD", place).alias("project_id"),
        F.when(segment == "AUTOMOBILE", entity).alias("author_id"),
        F.when(segment.isin("MACHINERY", "HOUSEHOLD"), entity).alias("engineer_id"),
    )
    return cross.metric_router(Domain.from_star(spark, sf_dir), filters)


@_star_query
def metric_router_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with none, one, three or four filters, which no pair answers; a zero counts as no filter."""
    key = F.col("c_custkey")
    given = lambda *kinds: (key % 8).isin(*kinds)
    filters = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        key.alias("request_id"),
        F.when(given(1, 5, 7), key % 20 + 1).when(given(6), F.lit(0)).alias("team_id"),
        F.when(given(2, 5, 6, 7), key % 25 + 1).alias("project_id"),
        F.when(given(3, 7), key % 90 + 1).alias("author_id"),
        F.when(given(4, 5, 7), key % 30 + 1).alias("engineer_id"),
    )
    return cross.metric_router(Domain.from_star(spark, sf_dir), filters)


# -- stored issue facts -----------------------------------------------------------------------------------------------


@_query()
def ai_impact_base(d: Domain) -> DataFrame:
    return stored_facts.ai_impact_base(d).withColumn("team_ids", _text_list("team_ids"))


@_query()
def ai_impact_base_deduplicated(d: Domain) -> DataFrame:
    return stored_facts.ai_impact_base(d, dedupe=True).withColumn("team_ids", _text_list("team_ids"))


@_query()
def ai_impact_summary(d: Domain) -> DataFrame:
    return stored_facts.ai_impact_summary(d, AS_OF).withColumn("team_ids", _text_list("team_ids"))


def _stored_summary(d: Domain, label: str) -> tuple[TableStore, DataFrame]:
    store = _store(d, label)
    return store, store.replace("ai_impact_summary", stored_facts.ai_impact_summary(_until(d, MARK), MARK_TIME))


@_query()
def ai_impact_incremental(d: Domain) -> DataFrame:
    _, stored = _stored_summary(d, "ai_impact_incremental")
    mark = stored.agg(F.max("last_updated")).first()[0].date()
    return stored_facts.ai_impact_incremental(d, stored, mark, AS_OF).withColumn("team_ids", _text_list("team_ids"))


@_query()
def summary_merge(d: Domain) -> DataFrame:
    store, _ = _stored_summary(d, "summary_merge")
    delta = stored_facts.summary_delta(d, stored_facts.changed_since(d, MARK), AS_OF)
    return store.upsert("ai_impact_summary", delta, "issue_id").withColumn("team_ids", _text_list("team_ids"))


@_query()
def summary_full_refresh(d: Domain) -> DataFrame:
    store, _ = _stored_summary(d, "summary_full_refresh")
    return store.replace("ai_impact_summary", stored_facts.ai_impact_summary(d, AS_OF)).withColumn(
        "team_ids", _text_list("team_ids")
    )


@_query()
def ai_impact_view(d: Domain) -> DataFrame:
    view = stored_facts.create_impact_view(stored_facts.ai_impact_summary(d, AS_OF))
    return view.withColumn("team_ids", _text_list("team_ids"))


_query("ai_impact_from_summary")(
    lambda d: stored_facts.impact_from_summary(d, stored_facts.ai_impact_summary(d, AS_OF))
)
_query("ai_impact_from_summary_of_engineer")(
    lambda d: stored_facts.impact_from_summary(d, stored_facts.ai_impact_summary(d, AS_OF), engineer=1)
)
_query("ai_impact_from_summary_by_author")(
    lambda d: stored_facts.impact_from_summary_by(stored_facts.ai_impact_summary(d, AS_OF), "author_id", "project_id")
)


@_query()
def issues_of_team(d: Domain) -> DataFrame:
    rows = stored_facts.issues_of_team(stored_facts.ai_impact_base(d), 1)
    return rows.withColumn("team_ids", _text_list("team_ids"))


@_query()
def issue_commits(d: Domain) -> DataFrame:
    return d.jira_issues.join(d.commits, F.col("issue_id") == F.col("jira_issue_id")).select(
        "issue_id", "category", "creation_date", "resolution_date", "commit_id", "commit_date", "ai_used"
    )


_query("commit_teams_all")(
    lambda d: stored_facts.commit_teams_all(d).select("commit_id", "engineer_id", "commit_date", "ai_used", "team_id")
)
_query("commit_teams_first")(
    lambda d: stored_facts.commit_teams_first(d).select("commit_id", "engineer_id", "commit_date", "ai_used", "team_id")
)

# -- refresh ----------------------------------------------------------------------------------------------------------


def _engineer_rows(d: Domain) -> DataFrame:
    return refresh.metric_rows(d, "engineer").select("engineer_id", *SUMMARY).withColumn("last_calculated", fx.instant(AS_OF))


@_query()
def metrics_upsert(d: Domain) -> DataFrame:
    store = _store(d, "metrics_upsert")
    refresh.refresh(_until(d, date(1995, 6, 30)), store, "engineer", MARK_TIME)
    newer = d.commits.where(F.col("commit_date") > F.lit(date(2001, 8, 1))).select("engineer_id").distinct()
    return refresh.refresh(d, store, "engineer", AS_OF, newer).select("engineer_id", *SUMMARY, "last_calculated")


@_query()
def metrics_lookup(d: Domain) -> DataFrame:
    stored = _store(d, "metrics_lookup").replace("engineer_metrics_materialized", _engineer_rows(d))
    return tables.metrics_lookup(stored, "engineer_id", 1)


def _current(dimension: str, *shown: str, **how) -> Callable[[Domain], DataFrame]:
    """Reads a stored table that holds the state at MARK: everything is outdated by AS_OF and refreshed first."""

    def plan(d: Domain) -> DataFrame:
        store = _store(d, f"current_{dimension}")
        refresh.refresh(_until(d, MARK), store, dimension, MARK_TIME)
        rows = refresh.current(d, store, dimension, AS_OF, **how)
        return rows.select(refresh.KEYS[dimension], *SUMMARY, *shown, "last_calculated")

    return plan


_query("current_team_metrics")(_current("team", "ai_adoption_rate"))
_query("current_engineer_metrics")(_current("engineer", "efficiency_score", limit=30, offset=10))
_query("current_project_metrics")(_current("project"))
_query("current_author_metrics")(_current("author", "efficiency_score", limit=20, offset=5))
_query("current_category_metrics")(_current("category"))


STALE_FROM = datetime(2001, 6, 25)
STALE_UNTIL = date(2001, 6, 30)


@_query()
def stale_entities(d: Domain) -> DataFrame:
    return refresh.stale_entities(d, refresh.last_touched(_until(d, STALE_UNTIL)), fx.instant(STALE_FROM))


@_query()
def affected_entities(d: Domain) -> DataFrame:
    return refresh.affected_entities(d.commits.where(F.col("commit_date") > F.lit(date(2001, 9, 1))), d)


@_query()
def changed_issues(d: Domain) -> DataFrame:
    known = d.jira_issues.where(F.col("creation_date") <= F.lit(MARK))
    before = known.withColumn("resolution_date", F.when(F.col("resolution_date") <= F.lit(MARK), F.col("resolution_date")))
    return changed_rows(d.jira_issues, before, "issue_id", ("resolution_date", "project_id", "category"))


def _aged_tables(d: Domain, store: TableStore) -> None:
    """Stored tables as of STALE_UNTIL, each row stamped with the day of the entity's last commit."""
    earlier = _until(d, STALE_UNTIL)
    rolled = refresh.share(earlier, store, dict.fromkeys(refresh.KEYS), store.replace("engineer_rollup", engineer_rollup(earlier)), last=True)
    touched = refresh.last_touched(earlier, rolled)
    for dimension, key in refresh.KEYS.items():
        rows = refresh.metric_rows(earlier, dimension, rolled).join(touched[dimension], key)
        store.replace(refresh.table_name(dimension), rows)


@_query()
def refresh_all_metrics(d: Domain) -> DataFrame:
    store = _store(d, "refresh_all_metrics")
    _aged_tables(d, store)
    return refresh.all_rows(refresh.refresh_all(d, store, STALE_FROM + timedelta(hours=24), max_age_hours=24))


@_query()
def refresh_report(d: Domain) -> DataFrame:
    store = _store(d, "refresh_report")
    _aged_tables(d, store)
    done = refresh.refresh_all(d, store, AS_OF, dimensions=tuple(refresh.KEYS))
    failures = store.read("refresh_failures") if store.exists("refresh_failures") else None
    return refresh.refresh_report(d, done, AS_OF, failures=failures)


@_query()
def refresh_log(d: Domain) -> DataFrame:
    store = _store(d, "refresh_log")
    for dimension in ("project", "category"):
        refresh.refresh(d, store, dimension, AS_OF)
        store.log_refresh(refresh.table_name(dimension), AS_OF)
    return store.read("refresh_log")


# -- dashboard --------------------------------------------------------------------------------------------------------

_query("filter_options")(dashboard.filter_options)
_query("category_chart")(lambda d: dashboard.category_chart(stored_facts.ai_impact_summary(d, AS_OF)))
_query("category_chart_first")(
    lambda d: dashboard.category_chart(stored_facts.ai_impact_summary(d, AS_OF), mode="first")
)
_query("project_improvements")(lambda d: dashboard.project_improvements(issue_fact(d)))
_query("overall_improvement")(
    lambda d: dashboard.overall_improvement(dashboard.project_improvements(issue_fact(d)))
)
_query("dashboard_bundle")(dashboard.dashboard_bundle)

# -- sources and quality ----------------------------------------------------------------------------------------------


@_query()
def csv_ingest(d: Domain) -> DataFrame:
    path = f"{work_dir(d.spark, 'csv_ingest')}/teams.csv"
    csv_source.write_csv(d.teams, path)
    return csv_source.ingest(d.spark, path, "teams").accepted


@_query()
def csv_ingest_commits(d: Domain) -> DataFrame:
    path = f"{work_dir(d.spark, 'csv_ingest_commits')}/commits.csv"
    csv_source.write_csv(d.commits, path)
    return csv_source.ingest(d.spark, path, "commits").accepted


def _commit_lines(d: Domain) -> DataFrame:
    """Commits as CSV lines of an exporter that leaves out the last field of AI-assisted commits."""
    names = schemas.columns("commits")
    values = [F.col(n).cast("string") for n in names[:-1]]
    size = F.when(~F.col("ai_used"), F.col("lines_of_code").cast("string"))
    return d.commits.select(F.concat_ws(",", *values, size).alias(",".join(names)))


@_query()
def csv_rejects(d: Domain) -> DataFrame:
    path = f"{work_dir(d.spark, 'csv_rejects')}/commits.csv"
    # A separator that occurs nowhere keeps the lines and the header as they are.
    _commit_lines(d).write.options(header="true", sep="\u0001").csv(path)
    return csv_source.ingest(d.spark, path, "commits").rejected


@_query()
def csv_folder_mixed_headers(d: Domain) -> DataFrame:
    """Projects from two exports whose files order their columns differently."""
    folder = f"{work_dir(d.spark, 'csv_folder')}/projects"
    odd = F.col("project_id") % 2 == 1
    for part, columns in ((d.projects.where(odd), ("project_id", "project_name")), (d.projects.where(~odd), ("project_name", "project_id"))):
        part.select(*columns).write.mode("append").options(header="true").csv(folder)
    return csv_source.ingest(d.spark, folder, "projects").accepted


@_query()
def csv_reject_count(d: Domain) -> DataFrame:
    path = f"{work_dir(d.spark, 'csv_reject_count')}/commits.csv"
    _commit_lines(d).write.options(header="true", sep="\u0001").csv(path)
    found = csv_source.ingest(d.spark, path, "commits")
    return d.spark.range(1).select(F.lit(found.rejected.count()).cast("bigint").alias("rejected"), F.lit(found.accepted.count()).cast("bigint").alias("accepted"))


@_query()
def seed_all(d: Domain) -> DataFrame:
    folder = work_dir(d.spark, "seed_all")
    for table in schemas.TABLES:
        csv_source.write_csv(d.table(table), f"{folder}/{table}.csv")
    loaded = tables.seed_all(d.spark, folder)
    return tables.table_counts(Domain.from_tables({t: i.accepted for t, i in loaded.items()}))


def _raw_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits as untyped text with the flaws typing has to cope with."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    flag = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "TRUE").when(
        F.col("l_returnflag") != "N", "False"
    )
    return items.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("commit_id"),
        F.concat(F.lit(" "), (F.col("l_suppkey") + 1).cast("string")).alias("engineer_id"),
        F.concat((F.col("l_orderkey") + 1).cast("string"), F.lit("abc")).alias("jira_issue_id"),
        (F.col("l_partkey") + 1).cast("string").alias("repo_id"),
        fx.iso_day("l_shipdate").alias("commit_date"),
        flag.alias("ai_used"),
        F.when(F.col("l_discount") > 0, F.col("l_quantity").cast("string")).otherwise("").alias("lines_of_code"),
    )


@_star_query
def typed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_source.typed_projection(_raw_commits(spark, sf_dir), "commits", mode="quarantine")


@_star_query
def load_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_source.load_metrics(typed_projection(spark, sf_dir), "commits")


_query("table_sample")(lambda d: tables.table_sample(d, "commits"))
_query("table_counts")(tables.table_counts)
_query("entity_keys")(tables.entity_keys)
_query("distinct_entity_counts")(tables.distinct_entity_counts)
_query("category_issue_counts")(tables.issue_counts)
_query("pk_duplicates")(quality.pk_duplicates)
_query("fk_orphans")(quality.fk_orphans)
_query("null_violations")(quality.null_violations)


@_query()
def pk_duplicates_found(d: Domain) -> DataFrame:
    """Tables in which some projects and the commits of some repositories come twice."""
    projects = d.projects.unionByName(d.projects.where("project_id <= 3"))
    return quality.pk_duplicates(d.having(projects=projects, commits=d.commits.unionByName(d.commits.where("repo_id % 7 = 0"))))


@_query()
def fk_orphans_found(d: Domain) -> DataFrame:
    """Tables that lack every tenth engineer, every ninth repository and project 5."""
    return quality.fk_orphans(
        d.having(engineers=d.engineers.where("id % 10 <> 0"), repositories=d.repositories.where("repo_id % 9 <> 0"), projects=d.projects.where("project_id <> 5"))
    )


@_query()
def null_violations_found(d: Domain) -> DataFrame:
    """Commits without engineer and issues without project here and there."""
    commits = d.commits.withColumn("engineer_id", F.when(F.col("repo_id") % 11 != 0, F.col("engineer_id")))
    issues = d.jira_issues.withColumn("project_id", F.when(F.col("issue_id") % 13 != 0, F.col("project_id")))
    return quality.null_violations(d.having(commits=commits, jira_issues=issues))


@_query()
def metrics_validation_failed(d: Domain) -> DataFrame:
    """Documents of engineers of which some lack their metrics."""
    kept = F.when(F.col("engineer_id") % 3 != 0, F.struct(*SUMMARY))
    document = F.to_json(F.struct(F.col("engineer_id").alias("engineerId"), F.col("engineer_name").alias("engineerName"), kept.alias("metrics")))
    documents = rollups.engineer_metrics(d).select(document.alias("document"))
    return quality.metrics_validation(documents, "document", ("engineerId", "engineerName", "metrics"))


@_query()
def metrics_validation(d: Domain) -> DataFrame:
    document = F.to_json(
        F.struct(
            F.col("engineer_id").alias("engineerId"), F.col("engineer_name").alias("engineerName"), F.struct(*SUMMARY).alias("metrics")
        )
    )
    documents = rollups.engineer_metrics(d).select(document.alias("document"))
    return quality.metrics_validation(documents, "document", ("engineerId", "engineerName", "metrics"))


@_query()
def scalar_functions(d: Domain) -> DataFrame:
    joined = d.jira_issues.join(d.commits, F.col("issue_id") == F.col("jira_issue_id"))
    days = fx.days_between("commit_date", "resolution_date")
    return joined.select(
        "commit_id",
        days.alias("days"),
        fx.clamped_days("commit_date", "resolution_date").alias("clamped"),
        fx.month_text("commit_date").alias("month"),
        fx.month_start("commit_date").alias("month_start"),
        fx.partition_name("commit_date").alias("partition"),
        fx.iso_day("creation_date").alias("iso_day"),
        F.add_months("commit_date", 1).alias("next_month"),
        F.date_add("commit_date", 6).alias("week_end"),
        F.nullif(F.col("lines_of_code"), F.lit(1)).alias("not_one"),
        F.coalesce(days, F.lit(0)).alias("days_or_zero"),
        F.least(F.lit(100), F.greatest(F.lit(0), F.col("lines_of_code") * 3)).alias("held"),
        fx.to_fixed(F.try_divide(days.cast("double"), F.col("lines_of_code").cast("double"))).alias("rounded"),
        F.ceil(F.try_divide(F.col("lines_of_code").cast("double"), F.lit(7.0))).alias("ceiled"),
        cross.dimension_key(F.lit("engineer-project"), F.col("engineer_id"), F.col("project_id")).alias("pair_key"),
        F.get_json_object(F.to_json(F.struct(F.col("category").alias("c"))), "$.c").alias("json_category"),
    )


@_query()
def sql_days_between(d: Domain) -> DataFrame:
    sql_functions.register(d)
    return d.spark.sql(
        """SELECT project_id, category, count(*) AS issues, sum(days_between(creation_date, resolution_date)) AS days
           FROM jira_issues WHERE resolution_date IS NOT NULL GROUP BY project_id, category"""
    )


# -- partitions -------------------------------------------------------------------------------------------------------


@_query()
def partition_plan(d: Domain) -> DataFrame:
    return partitions.partition_plan(d.spark, periods.first_day(d.commits), END)


_query("partition_info")(lambda d: partitions.partition_info(d.commits))
_query("partition_retention")(lambda d: partitions.partition_retention(d.commits, END))


@_query()
def commits_partitioned(d: Domain) -> DataFrame:
    path = work_dir(d.spark, "commits_partitioned")
    partitions.write_by_month(d.commits, path)
    return partitions.read_by_month(d.spark, path)


@_query()
def recommit_date(d: Domain) -> DataFrame:
    folder = work_dir(d.spark, "recommit_date")
    partitions.write_by_month(d.commits, f"{folder}/commits")
    moved = d.commits.agg(F.min_by("commit_id", F.struct("commit_date", "commit_id"))).first()[0]
    partitions.recommit_date(d.spark, f"{folder}/commits", moved, END, f"{folder}/staging")
    return partitions.read_by_month(d.spark, f"{folder}/commits")


@_query()
def recommit_date_everywhere(d: Domain) -> DataFrame:
    """An id that commits of many months bear, here their repository's, moved to one day."""
    folder = work_dir(d.spark, "recommit_date_everywhere")
    shared = d.commits.withColumn("commit_id", F.concat(F.lit("r"), F.col("repo_id").cast("string")))
    partitions.write_by_month(shared, f"{folder}/commits")
    partitions.recommit_date(d.spark, f"{folder}/commits", "r1", END, f"{folder}/staging")
    stored = partitions.read_by_month(d.spark, f"{folder}/commits")
    return stored.groupBy("commit_month", "commit_date", "commit_id").agg(F.count(F.lit(1)).alias("commits"), F.sum("lines_of_code").alias("lines"))


@_query()
def partition_retention_applied(d: Domain) -> DataFrame:
    """Commits by month after the old months were moved: where each month is, and that its files hold something."""
    folder = work_dir(d.spark, "partition_retention_applied")
    partitions.write_by_month(d.commits, f"{folder}/commits")
    partitions.apply_retention(d.spark, f"{folder}/commits", END, archive=f"{folder}/archive")
    places = [(name, partitions.stored_info(d.spark, f"{folder}/{name}")) for name in ("commits", "archive")]
    rows = [info.select(F.lit(name).alias("place"), "partition_name", "row_count", (F.col("size_bytes") > 0).alias("stored")) for name, info in places]
    return rows[0].unionByName(rows[1])


_query("author_page_after")(lambda d: ranking.page_after(rollups.author_metrics(d), "author_id", after=30, limit=20))


# -- streams ----------------------------------------------------------------------------------------------------------


def _commit_files(d: Domain, folder: str) -> DataFrame:
    """The commits written out as files and read back as a stream of two batches."""
    d.commits.repartitionByRange("commit_date").write.parquet(f"{folder}/arriving")
    files = len(d.spark.read.parquet(f"{folder}/arriving").inputFiles())
    return streams.commit_stream(d.spark, f"{folder}/arriving", files_per_batch=(files + 1) // 2)


@_query()
def stream_affected_refresh(d: Domain) -> DataFrame:
    folder = work_dir(d.spark, "stream_affected_refresh")
    store = TableStore(d.spark, f"{folder}/store")
    streams.affected_refresh(_commit_files(d, folder), d, store, f"{folder}/checkpoint", AS_OF).awaitTermination()
    return refresh.all_rows({k: store.read(refresh.table_name(k)) for k in refresh.REFRESHED})


def _late_files(d: Domain, folder: str) -> DataFrame:
    late = d.having(commits=d.commits.where(F.col("commit_date") > F.lit(MARK)))
    return _commit_files(late, folder)


@_query()
def stream_on_stored_metrics(d: Domain) -> DataFrame:
    """Metrics stored from the commits up to MARK, kept by a stream of the later ones."""
    folder, early = work_dir(d.spark, "stream_on_stored_metrics"), _until(d, MARK)
    store = TableStore(d.spark, f"{folder}/store")
    refresh.refresh_all(early, store, MARK_TIME)
    late = _late_files(d, folder)
    streams.affected_refresh(late, d, store, f"{folder}/checkpoint", AS_OF, history=early.commits).awaitTermination()
    return refresh.all_rows({k: store.read(refresh.table_name(k)) for k in refresh.REFRESHED}).drop("last_calculated")


@_query()
def stream_on_stored_summary(d: Domain) -> DataFrame:
    """A summary stored from the commits up to MARK, kept by a stream of the later ones."""
    folder, early = work_dir(d.spark, "stream_on_stored_summary"), _until(d, MARK)
    store = TableStore(d.spark, f"{folder}/store")
    store.replace("ai_impact_summary", stored_facts.ai_impact_summary(early, MARK_TIME))
    late = _late_files(d, folder)
    streams.incremental_summary(late, d, store, f"{folder}/checkpoint", AS_OF, history=early.commits).awaitTermination()
    return store.read("ai_impact_summary").drop("last_updated").withColumn("team_ids", _text_list("team_ids"))


@_query()
def changed_tables_refresh(d: Domain) -> DataFrame:
    """Metrics stored while what was resolved after MARK was still open, kept after these issues changed."""
    store = _store(d, "changed_tables_refresh")
    open_then = F.when(F.col("resolution_date") <= F.lit(MARK), F.col("resolution_date"))
    issues = d.jira_issues.withColumn("resolution_date", open_then)
    refresh.refresh_all(d.having(jira_issues=issues), store, MARK_TIME, dimensions=("project", "category"))
    streams.changed_tables_refresh(d, store, AS_OF, issues_before=issues)
    rows = refresh.all_rows({k: store.read(refresh.table_name(k)) for k in ("project", "category")})
    return rows.drop("last_calculated")


@_query()
def stream_incremental_summary(d: Domain) -> DataFrame:
    folder = work_dir(d.spark, "stream_incremental_summary")
    store = TableStore(d.spark, f"{folder}/store")
    streams.incremental_summary(_commit_files(d, folder), d, store, f"{folder}/checkpoint", AS_OF).awaitTermination()
    return store.read("ai_impact_summary").withColumn("team_ids", _text_list("team_ids"))


# -- stored tables by bucket, sets of tables, moves and retries ---------------------------------------------------------


def _impact_tables(d: Domain, label: str) -> ImpactTables:
    """The impact tables at MARK, brought up to date from the commits stored by month."""
    folder = work_dir(d.spark, label)
    partitions.write_by_month(d.commits, f"{folder}/commits")
    kept = ImpactTables(BucketStore(d.spark, f"{folder}/store"))
    kept.rebuild(_until(d, MARK), MARK_TIME)
    kept.advance(d, f"{folder}/commits", AS_OF)
    return kept


@_query()
def ai_impact_high_water(d: Domain) -> DataFrame:
    summary = _impact_tables(d, "ai_impact_high_water").store.read("ai_impact_summary")
    return summary.withColumn("team_ids", _text_list("team_ids"))


@_query()
def issues_of_team_posted(d: Domain) -> DataFrame:
    """One team's issues from the postings."""
    rows = _impact_tables(d, "issues_of_team_posted").issues_of_team(1)
    return rows.drop("last_updated").withColumn("team_ids", _text_list("team_ids"))


@_query()
def metrics_upsert_buckets(d: Domain) -> DataFrame:
    """Engineers' metrics of mid-1995 in buckets, of which a refresh of those with late commits writes the touched ones."""
    store = BucketStore(d.spark, work_dir(d.spark, "metrics_upsert_buckets"), bucket_rows=16)
    refresh.refresh(_until(d, date(1995, 6, 30)), store, "engineer", MARK_TIME)
    newer = d.commits.where(F.col("commit_date") > F.lit(date(2001, 8, 1))).select("engineer_id").distinct()
    return refresh.refresh(d, store, "engineer", AS_OF, newer).select("engineer_id", *SUMMARY, "last_calculated")


def _loads(d: Domain) -> tuple[LoadSets, list[tuple[str, DataFrame]]]:
    """Two loads of all tables with the commits up to MARK, in the second of which some engineers and repositories are missing."""
    sets = LoadSets(d.spark, work_dir(d.spark, "load_sets"))
    whole = {t: d.table(t) for t in schemas.TABLES}
    # Commits with a repeated key would not pass.
    early = _until(d, MARK).commits.dropDuplicates(list(schemas.PRIMARY_KEYS["commits"]))
    reports = [("first", sets.load(whole | {"commits": early}))]
    broken = whole | {"engineers": d.engineers.where("id % 10 <> 0"), "repositories": d.repositories.where("repo_id % 9 <> 0")}
    # The same commits, read as the first load stored them: they are made from the base tables once.
    stored = sets.current().commits if reports[0][1].isEmpty() else early
    reports.append(("broken", sets.load(broken | {"commits": stored})))
    return sets, reports


@_query()
def load_set_refused(d: Domain) -> DataFrame:
    """What readers see after a set with bad references was refused, and what was found in it."""
    sets, reports = _loads(d)
    seen = tables.table_counts(sets.current()).select(F.lit("seen").alias("place"), F.col("table_name").alias("name"), "n")
    found = [report.select(F.lit(place).alias("place"), F.col("subject").alias("name"), "n") for place, report in reports]
    return seen.unionByName(found[0]).unionByName(found[1])


@_query()
def load_set_published(d: Domain) -> DataFrame:
    """After the refused set, one of two tables that fit the published others."""
    sets, _ = _loads(d)
    few = d.commits.where("lines_of_code % 2 = 0").dropDuplicates(list(schemas.PRIMARY_KEYS["commits"]))
    sets.load({"commits": few, "teams": d.teams.where("team_id % 2 = 0")})
    return tables.table_counts(sets.current())


@_query()
def refresh_with_retries(d: Domain) -> DataFrame:
    """Metrics of all teams, one of which has an unreadable member list; it is left over with the number of its tries."""
    store = _store(d, "refresh_with_retries")
    bad = F.when(F.col("team_id") == 2, F.lit("1,x2")).otherwise(F.col("engineer_ids"))
    strict = StrictDomain(d.spark, d._tables | {"teams": d.teams.withColumn("engineer_ids", bad)})
    rows = refresh.refresh_guarded(strict, store, "team", AS_OF, rolled=store.replace("engineer_rollup", engineer_rollup(d)))
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in SUMMARY]
    left = store.read("refresh_retries").select(F.col("entity_key").cast("bigint").alias("team_id"), *none, F.col("tries"))
    return rows.select("team_id", *SUMMARY, F.lit(0).alias("tries")).unionByName(left)


# -- streams of changes -----------------------------------------------------------------------------------------------


def _live(d: Domain, label: str, as_of: datetime = AS_OF, dimensions: tuple[str, ...] = refresh.REFRESHED) -> tuple[Live, str]:
    folder = work_dir(d.spark, label)
    return Live(d, BucketStore(d.spark, f"{folder}/store"), as_of, dimensions), folder


def _fed(live: Live, folder: str, table: str, batches: list[DataFrame]) -> None:
    """Rows delivered in several goes; the stream is started anew for each and goes on from its checkpoint."""
    for rows in batches:
        rows.write.mode("append").option("compression", CODEC).parquet(f"{folder}/{table}-arriving")
        stream = _stream_of(live, f"{folder}/{table}-arriving", rows)
        run = live.commits if table == "commits" else (lambda s, c: live.rows(table, s, c))
        run(stream, f"{folder}/{table}-checkpoint").awaitTermination()


def _stream_of(live: Live, folder: str, like: DataFrame) -> DataFrame:
    return live.store.spark.readStream.schema(like.schema).parquet(folder)


def _kept(live: Live) -> DataFrame:
    return refresh.all_rows({k: live.store.read(refresh.table_name(k)) for k in refresh.REFRESHED}).drop("last_calculated")


def _named_apart(d: Domain) -> DataFrame:
    """Commits with ids of their own: where one repeats, the later rows get a number.

    An id begins with the number of its issue (`Domain.from_star`), so rows of one id are rows of one issue, by which the commits are partitioned as they are made.
    """
    nth = F.row_number().over(Window.partitionBy("jira_issue_id", "commit_id").orderBy("commit_date", "ai_used", "lines_of_code"))
    return d.commits.withColumn("nth", nth).withColumn("commit_id", F.when(F.col("nth") == 1, F.col("commit_id")).otherwise(F.concat_ws("#", "commit_id", "nth"))).drop("nth")


@_query()
def stream_commit_updates(d: Domain) -> DataFrame:
    """Metrics stored from wrong early versions of the commits, kept by a stream that corrects, repeats, delays and adds some."""
    # Written once: five tables are made from it.
    landed = f"{work_dir(d.spark, 'stream_commit_updates')}/final"
    _named_apart(d).write.option("compression", CODEC).parquet(landed)
    final = d.spark.read.parquet(landed)
    wrong = F.pmod(F.xxhash64("commit_id"), F.lit(3)) == 0
    first = final.withColumns({
        "commit_date": F.when(wrong, F.date_add("commit_date", (F.col("lines_of_code") % 21 - 10).cast("int"))).otherwise(F.col("commit_date")),
        "engineer_id": F.when(wrong & (F.col("lines_of_code") % 2 == 0), F.lit(1)).otherwise(F.col("engineer_id")),
        "jira_issue_id": F.when(wrong & (F.col("lines_of_code") % 5 == 0), F.lit(1)).otherwise(F.col("jira_issue_id")),
        "ai_used": F.col("ai_used") != wrong,
    })
    early = F.col("repo_id") % 2 == 0
    live, folder = _live(d.having(commits=first.where(early)), "stream_commit_updates")
    live.load("commits")
    versioned = lambda rows, n: rows.withColumn("version", F.lit(n).cast("long"))
    added = versioned(first.where(~early), 1)
    corrected = versioned(final.where(wrong), 2)
    again = versioned(first.where(F.col("repo_id") % 3 == 0), 1)
    _fed(live, folder, "commits", [added, corrected.union(again)])
    return _kept(live)


@_query()
def stream_issue_changes(d: Domain) -> DataFrame:
    """Metrics stored while later issues were open and some lay in other projects; the changes arrive, one batch of them irrelevant."""
    moved = F.col("issue_id") % 10 == 0
    open_then = F.when(F.col("resolution_date") <= F.lit(MARK), F.col("resolution_date"))
    before = d.jira_issues.withColumns({"resolution_date": open_then, "project_id": F.when(moved, F.lit(1).cast("long")).otherwise(F.col("project_id"))})
    live, folder = _live(d.having(jira_issues=before), "stream_issue_changes")
    live.load()
    versioned = lambda rows, n: rows.withColumn("version", F.lit(n).cast("long"))
    half = F.col("issue_id") % 2 == 0
    irrelevant = before.where("issue_id % 7 = 0").withColumn("author_id", F.col("author_id") + 1)
    late = versioned(before.where(half), 0)
    _fed(live, folder, "jira_issues", [versioned(irrelevant, 1), versioned(d.jira_issues.where(half), 2), versioned(d.jira_issues.where(~half), 2).union(late)])
    return _kept(live)


@_query()
def stream_team_changes(d: Domain) -> DataFrame:
    """Metrics stored when some teams had other members; the teams as they are arrive, and one again under a new name."""
    other = F.when(F.col("team_id") % 4 == 1, F.lit("1,2,3")).otherwise(F.col("engineer_ids"))
    live, folder = _live(d.having(teams=d.teams.withColumn("engineer_ids", other)), "stream_team_changes")
    live.load()
    versioned = lambda rows, n: rows.withColumn("version", F.lit(n).cast("long"))
    renamed = d.teams.where("team_id = 2").withColumn("team_name", F.lit("New"))
    _fed(live, folder, "teams", [versioned(d.teams.where("team_id % 8 = 1"), 1), versioned(d.teams, 2), versioned(renamed, 3)])
    return _kept(live)


@_query()
def current_from_stored(d: Domain) -> DataFrame:
    """Teams and projects stored at MARK and read at AS_OF: outdated, so refreshed from the stored tables and not from the commits."""
    live, _ = _live(d, "current_from_stored", MARK_TIME, ("team", "project"))
    live.load()
    return refresh.all_rows({k: live.current(k, AS_OF) for k in live.dimensions})
