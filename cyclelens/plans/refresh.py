"""Keeping the stored metric tables current: what is stale, what a change affects, and the refresh itself."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclelens.domain import Domain
from cyclelens.functions.scalars import instant
from cyclelens.operators.facts import ISSUE_COLUMNS, contributions, engineer_rollup, every_issue, lookup_join, measured, merge_rollups
from cyclelens.operators.merge import stale_keys
from cyclelens.operators.ranking import page
from cyclelens.operators.summarize import SUMMARY, TALLY, summarize, summary_of, tally
from cyclelens.plans import rollups
from cyclelens.sources.storage import TableStore

# Dimension -> key column of its stored table. Fixed values.
KEYS = {
    "team": "team_id",
    "engineer": "engineer_id",
    "project": "project_id",
    "category": "category",
    "author": "author_id",
}
# Refreshed together and on changes; authors only on request.
REFRESHED = ("team", "engineer", "project", "category")


def table_name(dimension: str) -> str:
    return f"{dimension}_metrics_materialized"


@dataclass(frozen=True)
class Tallied:
    """A rollup together with the stored `tallies` of some dimensions that were made from it, and what was stored along with them."""

    rolled: DataFrame
    tallied: DataFrame
    dimensions: tuple[str, ...]
    along: DataFrame | None = None


def metric_rows(domain: Domain, dimension: str, rolled: DataFrame | Tallied | None = None) -> DataFrame:
    """Stored metrics of every entity of a dimension, from the commits, their stored `engineer_rollup` or its tallies."""
    if isinstance(rolled, Tallied):
        return tallied_rows(domain, dimension, rolled.tallied) if dimension in rolled.dimensions else metric_rows(domain, dimension, rolled.rolled)
    if dimension == "team":
        return rollups.team_rows(domain, rollups.team_categories(domain, rolled))
    if dimension == "engineer":
        return rollups.scored(summarize(contributions(domain, every_engineer=True, rolled=rolled), "engineer_id"))
    if dimension == "author":
        return rollups.scored(summarize(every_issue(domain, rolled), "author_id"))
    if dimension in ("project", "category"):
        return summarize(every_issue(domain, rolled), KEYS[dimension])
    raise ValueError(f"Unknown dimension: {dimension}")


#: Dimensions whose entities own issues, as against those whose entities commit to them.
OF_ISSUES = ("project", "category", "author")


def beside_issues(domain: Domain, rolled: DataFrame, last: bool = False, signed: bool = False) -> DataFrame:
    """The rollup beside its issues, of which each row has a number. With `signed`, of one day each: signed counts are added up, and what comes to nothing goes.

    All columns are grouped by then, so whatever is made from these rows, they are shuffled alike, and once in a query.
    """
    numbered = domain.jira_issues.select(*ISSUE_COLUMNS).withColumn("_row", F.monotonically_increasing_id())
    dates, counts = ["first_commit_date", *(["last_commit_date"] if last else [])], ["total_commits", "ai_commits"]
    joined = rolled.select("issue_id", "engineer_id", *dates, *counts).join(numbered.hint("merge"), "issue_id", "left")
    if not signed:
        return joined
    summed = joined.groupBy(*[c for c in joined.columns if c not in counts]).agg(*[F.sum(c).alias(c) for c in counts])
    return summed.where((F.col("total_commits") != 0) | (F.col("ai_commits") != 0)).select(*joined.columns)


def tallies(domain: Domain, rolled: DataFrame, dimensions: Iterable[str], last: bool = False, joined: DataFrame | None = None) -> DataFrame:
    """(dimension, entity_key, category of a team's tally, tally) of all entities of several dimensions, from one shuffle of the rollup by issue.

    The rollup may hold several rows per (issue, engineer): they are merged where they meet the issues, once for each entity that sees them. With
    `last`, the day of the last commit is given as well; for a team, of the last commit to a resolved issue. The issues are not broadcast, however
    few: the rows would be shuffled after they are repeated for each entity, and not before. A hot issue is still split. `joined` is the rollup
    `beside_issues`, if that was made.
    """
    joined = beside_issues(domain, rolled, last) if joined is None else joined
    dates = ["first_commit_date", *(["last_commit_date"] if last else [])]

    def seen_by(kind: str, entity: Column, *kept: str) -> Column:
        # A row of the issues that repeats counts again, but not for a team, for which equal ones are one.
        columns = ("_row", "project_id", "author_id", "category")
        values = [(F.col(c) if c in kept else F.lit(None).cast(joined.schema[c].dataType)).alias(c) for c in columns]
        return F.struct(F.lit(kind).alias("dimension"), entity.cast("string").alias("entity_key"), *values)

    views = []
    if "engineer" in dimensions:
        views.append(F.array(seen_by("engineer", F.col("engineer_id"), "_row")))
    if any(d in OF_ISSUES for d in dimensions):
        views.append(F.when(F.col("_row").isNotNull(), F.array(seen_by("issue", F.lit(None), *ISSUE_COLUMNS, "_row"))))
    if "team" in dimensions:
        teams = domain.members.groupBy("engineer_id").agg(F.collect_list("team_id").alias("_teams"))
        joined = lookup_join(joined, teams, "engineer_id", "left", domain.members_are_few)
        views.append(F.when(F.col("resolution_date").isNotNull(), F.transform("_teams", lambda t: seen_by("team", t, "category"))))
    counts = [*dates, "total_commits", "ai_commits"]
    each = joined.select("issue_id", "resolution_date", *counts, F.explode(F.flatten(F.array_compact(F.array(*views)))).alias("v"))
    each = each.select("issue_id", "resolution_date", "v.*", *counts)
    facts = measured(merge_rollups(each, *[c for c in each.columns if c not in counts]))

    owned = [F.struct(F.lit(d).alias("dimension"), F.col(KEYS[d]).cast("string").alias("entity_key")) for d in dimensions if d in OF_ISSUES]
    figures = ["has_ai_commits", "cycle_time", "total_commits", *dates[1:]]
    if owned:
        own = F.when(F.col("dimension") == "issue", F.array(*owned)).otherwise(F.array(F.struct("dimension", "entity_key")))
        team_category = F.when(F.col("dimension") == "team", F.col("category")).alias("category")
        facts = facts.select(F.explode(own).alias("e"), team_category, *figures).select("e.*", "category", *figures)
        # Also what has no commits owns a row.
        owners = domain.jira_issues.select(F.explode(F.array(*owned)).alias("e")).select("e.*")
        facts = facts.unionByName(owners, allowMissingColumns=True)
    return tally(facts, "dimension", "entity_key", "category", also=[F.max(c).alias(c) for c in dates[1:]])


def share(
    domain: Domain,
    store: TableStore,
    due: Mapping[str, DataFrame | None],
    rolled: DataFrame,
    parts: DataFrame | None = None,
    last: bool = False,
    signed: bool = False,
    along: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame | Tallied:
    """The rollup with the tallies of those of the due dimensions of which most entities are due.

    These are made in one go, where each dimension by itself would shuffle the rollup. A dimension of which few entities are due is left out: it
    reads what concerns them alone. `parts` is the rollup before it was merged, if that is stored, and `signed` says that it has signed counts. What cannot be
    computed together is left to each dimension, so that one which fails stops no other. `along` makes other rows, without a column `dimension`, of the
    rollup `beside_issues`; they are stored with the tallies by the same job.
    """
    wide = [d for d, keys in due.items() if keys is None or _are_most(store, d, keys)]
    try:
        if "team" in wide and not domain.members_are_few:
            wide.remove("team")
    except Exception:  # noqa: BLE001 - unreadable members fail again, and are noted, with the teams
        wide.remove("team")
    if len(wide) < 2:
        return rolled
    joined = beside_issues(domain, rolled if parts is None else parts, last, signed)
    tallied = tallies(domain, rolled, wide, last, joined)
    try:
        if along is None:
            return Tallied(rolled, store.replace("tallies", tallied), tuple(wide))
        others = along(joined)
        both = store.replace("tallies", tallied.unionByName(others, allowMissingColumns=True))
        own = F.col("dimension").isNotNull()
        return Tallied(rolled, both.where(own).select(*tallied.columns), tuple(wide), both.where(~own).select(*others.columns))
    except Exception:  # noqa: BLE001 - as above
        return rolled


def _are_most(store: TableStore, dimension: str, keys: DataFrame) -> bool:
    name = table_name(dimension)
    return not store.exists(name) or 2 * keys.count() >= store.read(name).count()


def _entity_key(domain: Domain, dimension: str) -> Column:
    tables = {"team": domain.teams, "engineer": domain.commits}
    kind = tables.get(dimension, domain.jira_issues).schema[KEYS[dimension]].dataType
    return F.col("entity_key").cast(kind).alias(KEYS[dimension])


def tallied_rows(domain: Domain, dimension: str, tallied: DataFrame) -> DataFrame:
    """`metric_rows` from `tallies`."""
    key = _entity_key(domain, dimension)
    own = tallied.where(F.col("dimension") == dimension)
    if dimension == "team":
        return rollups.team_rows(domain, own.select(key, "category", *TALLY))
    rows = summary_of(own.select(key, *TALLY))
    return rollups.scored(rows) if dimension in ("engineer", "author") else rows


def restrict(
    domain: Domain, dimension: str, keys: DataFrame, rolled: DataFrame | None = None
) -> tuple[Domain, DataFrame | None]:
    """The tables (and the stored rollup) cut down to what the metrics of the given entities are made of.

    Catalyst moves a semi join below an aggregate only if it can broadcast it, so the cut is made at the source.
    """

    def committed_by(engineers: DataFrame, source: Domain) -> tuple[Domain, DataFrame | None]:
        if rolled is not None:
            return source, lookup_join(rolled, engineers, "engineer_id", "left_semi")
        return source.having(commits=lookup_join(domain.commits, engineers, "engineer_id", "left_semi")), None

    if dimension == "engineer":
        return committed_by(keys, domain)
    if dimension == "team":
        chosen = domain.having(teams=domain.teams.join(keys, "team_id", "left_semi"))
        return committed_by(chosen.members.select("engineer_id").distinct(), chosen)
    issues = lookup_join(domain.jira_issues, keys, KEYS[dimension], "left_semi")
    return domain.having(jira_issues=issues), rolled


def owners(domain: Domain, dimension: str, rolled: DataFrame | None = None) -> DataFrame:
    """Entities that own a row in the dimension's table."""
    if dimension == "team":
        return domain.teams.select("team_id")
    if dimension == "engineer":
        return (domain.commits if rolled is None else rolled).select("engineer_id").distinct()
    return domain.jira_issues.select(KEYS[dimension]).distinct()


def last_touched(domain: Domain, rolled: DataFrame | Tallied | None = None) -> dict[str, DataFrame]:
    """Per dimension, (key, last_calculated): the day of the last commit that concerned the entity.

    This is the state the tables are in when every commit refreshed its entities on arrival.
    """
    day = F.max("last_commit_date").cast("timestamp_ntz").alias("last_calculated")
    if isinstance(rolled, Tallied) and set(rolled.dimensions) >= set(KEYS):
        found = rolled.tallied.where(F.col("last_commit_date").isNotNull())
        own = {d: found.where(F.col("dimension") == d).select(_entity_key(domain, d), "last_commit_date") for d in KEYS}
        # All commits of the members count, and not only those to resolved issues.
        own["team"] = lookup_join(own["engineer"], domain.members, "engineer_id", "inner", domain.members_are_few)
        return {d: own[d].groupBy(key).agg(day) for d, key in KEYS.items()}
    rolled = rolled.rolled if isinstance(rolled, Tallied) else engineer_rollup(domain) if rolled is None else rolled
    per_engineer = merge_rollups(rolled, "engineer_id")
    issues = domain.jira_issues.select("issue_id", "project_id", "author_id", "category")
    per_issue = issues.join(merge_rollups(rolled, "issue_id"), "issue_id")
    per_member = lookup_join(per_engineer, domain.members, "engineer_id", "inner", domain.members_are_few)
    source = {"team": per_member, "engineer": per_engineer}
    return {d: source.get(d, per_issue).groupBy(key).agg(day) for d, key in KEYS.items()}


def _as_entities(df: DataFrame, dimension: str) -> DataFrame:
    return df.select(F.lit(dimension).alias("dimension"), F.col(KEYS[dimension]).cast("string").alias("entity_key"))


def stale_entities(domain: Domain, stored: dict[str, DataFrame], cutoff: Column) -> DataFrame:
    """(dimension, entity_key) of all entities whose stored metrics are missing or older than the cutoff."""
    found = [
        _as_entities(stale_keys(owners(domain, d), stored[d], KEYS[d], cutoff), d) for d in REFRESHED if d in stored
    ]
    return reduce(DataFrame.unionByName, found)


def affected_entities(changed_commits: DataFrame, domain: Domain) -> DataFrame:
    """(dimension, entity_key) that a set of changed commits concerns: engineers, all their teams, projects, categories.

    The changed commits are reduced to distinct engineers and issues before they are looked up.
    """
    engineers = changed_commits.select("engineer_id").distinct()
    teams = lookup_join(engineers, domain.members, "engineer_id", "inner", domain.members_are_few)
    touched = changed_commits.select(F.col("jira_issue_id").alias("issue_id")).distinct()
    issues = domain.jira_issues.select("issue_id", "project_id", "category").join(touched, "issue_id", "left_semi")
    return reduce(
        DataFrame.unionByName,
        [
            _as_entities(engineers, "engineer"),
            _as_entities(teams.select("team_id").distinct(), "team"),
            _as_entities(issues.select("project_id").distinct(), "project"),
            _as_entities(issues.select("category").distinct(), "category"),
        ],
    )


def affected_by_issues(changed_issues: DataFrame) -> DataFrame:
    """Projects and categories of changed issues; engineers and teams wait for the periodic refresh."""
    return _as_entities(changed_issues.select("project_id").distinct(), "project").unionByName(
        _as_entities(changed_issues.select("category").distinct(), "category")
    )


def affected_by_teams(changed_teams: DataFrame) -> DataFrame:
    return _as_entities(changed_teams.select("team_id").distinct(), "team")


def keys_of(affected: DataFrame, dimension: str) -> DataFrame:
    kind = "string" if dimension == "category" else "bigint"
    chosen = affected.where(F.col("dimension") == dimension)
    return chosen.select(F.col("entity_key").cast(kind).alias(KEYS[dimension]))


def refresh(
    domain: Domain,
    store: TableStore,
    dimension: str,
    as_of: datetime,
    keys: DataFrame | None = None,
    rolled: DataFrame | Tallied | None = None,
) -> DataFrame:
    """Recomputes all entities of a dimension, or those in `keys`, and merges them into its stored table."""
    return _refresh(domain, store, dimension, as_of, None if keys is None else store.replace(f"{dimension}_keys", keys), rolled)


def _refresh(
    domain: Domain, store: TableStore, dimension: str, as_of: datetime, keys: DataFrame | None, rolled: DataFrame | Tallied | None
) -> DataFrame:
    ready = isinstance(rolled, Tallied) and dimension in rolled.dimensions
    if isinstance(rolled, Tallied) and not ready:
        rolled = rolled.rolled
    if keys is not None and not ready:
        domain, rolled = restrict(domain, dimension, keys, rolled)
    if ready:
        rows = metric_rows(domain, dimension, rolled)
        rows = rows if keys is None else rows.join(keys, KEYS[dimension], "left_semi")
    elif dimension == "team":
        # Summary and ranking both read the tally; written, it is computed once, and it is no larger than its keys.
        rows = rollups.team_rows(domain, store.replace("team_categories", rollups.team_categories(domain, rolled)))
    else:
        rows = metric_rows(domain, dimension, rolled)
    # An entity that lost its last commit, or is no more, loses its row.
    return store.upsert(table_name(dimension), rows.withColumn("last_calculated", instant(as_of)), KEYS[dimension], gone=keys)


def refresh_all(
    domain: Domain,
    store: TableStore,
    as_of: datetime,
    max_age_hours: int = 24,
    force: bool = False,
    dimensions: tuple[str, ...] = REFRESHED,
) -> dict[str, DataFrame]:
    """Brings the stored tables up to date: every entity with `force`, else the missing and outdated ones.

    What is stale is found first, from the stored tables, the entity tables and the engineers of the commits; where nothing is, nothing is rolled up or
    written. Else the commits are read once: their rollup per (issue, engineer) is written, and all dimensions start from
    it. A dimension that fails is noted in `refresh_failures` and keeps its table; the others go on.
    """
    cutoff = instant(as_of - timedelta(hours=max_age_hours))
    due: dict[str, DataFrame | None] = {}
    for dimension in dimensions:
        if force or not store.exists(table_name(dimension)):
            due[dimension] = None
            continue
        stale = _stale(domain, store.read(table_name(dimension)), dimension, cutoff)
        if not stale.isEmpty():
            due[dimension] = store.replace(f"{dimension}_keys", stale)
    if due:
        rolled = share(domain, store, due, store.replace("engineer_rollup", engineer_rollup(domain)))
        for dimension, keys in due.items():
            name = table_name(dimension)
            try:
                _refresh(domain, store, dimension, as_of, keys, rolled)
                store.log_refresh(name, as_of)
            except Exception as error:  # noqa: BLE001 - one failing dimension must not stop the others
                log_failure(store, dimension, error, as_of)
            store.expire(name), store.expire(f"{name}_delta"), store.expire(f"{dimension}_keys")
        store.expire("engineer_rollup"), store.expire("tallies"), store.expire("team_categories")
    return {d: store.read(table_name(d)) for d in dimensions if store.exists(table_name(d))}


#: Times that an entity's refresh is tried before it is left to a person.
MOST_TRIES = 3
#: Entities that are tried one by one; a failing set is halved until it is no larger.
SINGLE = 1


def refresh_guarded(
    domain: Domain,
    store: TableStore,
    dimension: str,
    as_of: datetime,
    keys: DataFrame | None = None,
    rolled: DataFrame | None = None,
    most_tries: int = MOST_TRIES,
) -> DataFrame:
    """As `refresh`, but an entity that cannot be computed does not keep the others from it.

    All keys are one job, as usual. Only if that fails are they halved by a hash of the key, and a half that fails again, until the bad
    keys are alone: two jobs for each halving and bad key. These go to `refresh_retries` with the number of their tries; they are tried
    again with the next keys until they have failed `most_tries` times, and keep their last row meanwhile. Returns the table.
    """
    key = KEYS[dimension]
    wanted = owners(domain, dimension, rolled) if keys is None else keys
    retries = _retries(store, dimension)
    again = retries.where(F.col("tries") < most_tries).select(F.col("entity_key").cast(wanted.schema[key].dataType).alias(key))
    spent = retries.where(F.col("tries") >= most_tries).select(F.col("entity_key").cast(wanted.schema[key].dataType).alias(key))
    wanted = store.replace(f"{dimension}_wanted", wanted.unionByName(again).distinct().join(spent, key, "left_anti"))
    bad: list[tuple[str, str]] = []

    def attempt(part: DataFrame, depth: int) -> None:
        part = store.replace(f"{dimension}_keys", part)
        n = part.count()
        if not n:
            return
        try:
            _refresh(domain, store, dimension, as_of, part, rolled)
        except Exception as error:  # noqa: BLE001 - whatever fails is narrowed down to its entities
            if n <= SINGLE:
                bad.append((str(part.first()[0]), str(error).splitlines()[0][:500]))
                log_failure(store, dimension, error, as_of)
                return
            # Another bit of the hash each time; read from the stored table, as the keys of this half are replaced meanwhile.
            held = store.replace(f"{dimension}_held_{depth}", part)
            side = F.shiftright(F.xxhash64(F.lit(depth // 64), F.col(key)), depth % 64).bitwiseAND(F.lit(1))
            for half in (0, 1):
                attempt(held.where(side == half), depth + 1)

    attempt(wanted, 0)
    failed = store.spark.createDataFrame([(dimension, k, 1, m) for k, m in bad], RETRY)
    counted = failed.join(retries.select("entity_key", F.col("tries").alias("before")), "entity_key", "left")
    counted = counted.withColumn("tries", F.col("tries") + F.coalesce("before", F.lit(0))).drop("before").select(*failed.columns)
    others = store.read("refresh_retries").where(F.col("dimension") != dimension) if store.exists("refresh_retries") else failed.limit(0)
    untried = retries.join(spent.select(F.col(key).cast("string").alias("entity_key")), "entity_key", "left_semi")
    store.replace("refresh_retries", others.unionByName(untried).unionByName(counted))
    return store.read(table_name(dimension))


RETRY = "dimension string, entity_key string, tries int, message string"


def _retries(store: TableStore, dimension: str) -> DataFrame:
    if not store.exists("refresh_retries"):
        return store.spark.createDataFrame([], RETRY)
    return store.read("refresh_retries").where(F.col("dimension") == dimension)


def _stale(domain: Domain, stored: DataFrame, dimension: str, cutoff: Column) -> DataFrame:
    """Keys whose stored row is missing or outdated. An engineer owns a row by having commits, whether or not `engineers` knows the id."""
    return stale_keys(owners(domain, dimension), stored, KEYS[dimension], cutoff)


def log_failure(store: TableStore, dimension: str, error: Exception, as_of: datetime, batch: int | None = None) -> None:
    """One line in `refresh_failures`."""
    entry = store.spark.range(1).select(
        F.lit(batch).cast("int").alias("batch"),
        F.lit(dimension).alias("dimension"),
        F.lit(str(error)).alias("message"),
        instant(as_of).alias("failed_at"),
    )
    store.append("refresh_failures", entry)


def current(
    domain: Domain,
    store: TableStore,
    dimension: str,
    as_of: datetime,
    max_age_hours: int = 24,
    force: bool = False,
    entity: int | str | None = None,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Stored metrics of one dimension, refreshed first where missing or outdated; by key, one entity or a page.

    Only if a probe finds something stale is anything computed, and then only for the stale entities.
    """
    name, key = table_name(dimension), KEYS[dimension]
    wanted = owners(domain, dimension)
    if entity is not None:
        wanted = wanted.where(F.col(key) == F.lit(entity))
    if store.exists(name) and not force:
        wanted = stale_keys(wanted, store.read(name), key, instant(as_of - timedelta(hours=max_age_hours)))
    if force or not wanted.isEmpty():
        refresh(domain, store, dimension, as_of, None if force and entity is None else wanted)
    rows = store.read(name)
    if entity is not None:
        rows = rows.where(F.col(key) == F.lit(entity))
    return page(rows, key, limit, offset)


def all_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(dimension, entity_key, summary, last_calculated) over all dimensions."""
    rows = [
        df.select(
            F.lit(d).alias("dimension"), F.col(KEYS[d]).cast("string").alias("entity_key"), *SUMMARY, "last_calculated"
        )
        for d, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def refresh_report(
    domain: Domain,
    tables: dict[str, DataFrame],
    as_of: datetime,
    rolled: DataFrame | None = None,
    failures: DataFrame | None = None,
) -> DataFrame:
    """(dimension, processed, total, failed): entities calculated at `as_of`, entities there are, refreshes that failed then."""
    failed_at = {}
    if failures is not None:
        noted = failures.where(F.col("failed_at") == instant(as_of)).groupBy("dimension").count()
        failed_at = {r["dimension"]: r["count"] for r in noted.collect()}

    def line(dimension: str, df: DataFrame) -> DataFrame:
        done = df.agg(F.count_if(F.col("last_calculated") == instant(as_of)).alias("processed"))
        total = owners(domain, dimension, rolled).agg(F.count(F.lit(1)).alias("total")).scalar()
        failed = F.lit(failed_at.get(dimension, 0)).cast("bigint").alias("failed")
        return done.select(F.lit(dimension).alias("dimension"), "processed", total.alias("total"), failed)

    return reduce(DataFrame.unionByName, [line(d, df) for d, df in tables.items()])
