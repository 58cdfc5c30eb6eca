"""Metrics of pairs of dimensions, their stored lookup, checked requests, and the routing of filters to pairs."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclelens.domain import Domain
from cyclelens.functions.scalars import instant
from cyclelens.operators.facts import by_team, contributions, issue_fact, lookup_join, regroup, team_fact
from cyclelens.operators.summarize import AVERAGES, COUNTS, SUMMARY, summarize
from cyclelens.plans.impact import ai_impact

# Dimension type -> (primary entity, secondary entity). Fixed values, in routing order.
PAIRS = {
    "team-project": ("Team", "Project"),
    "engineer-project": ("Engineer", "Project"),
    "author-project": ("Author", "Project"),
    "team-engineer": ("Team", "Engineer"),
}


def dimension_key(kind: Column, primary: Column, secondary: Column) -> Column:
    return F.concat_ws(":", kind, primary.cast("string"), secondary.cast("string"))


def _pairs(summary: DataFrame, kind: str, primary: str, secondary: str) -> DataFrame:
    return summary.select(
        dimension_key(F.lit(kind), F.col(primary), F.col(secondary)).alias("dimension_key"),
        F.lit(kind).alias("dimension_type"),
        F.col(primary).alias("primary_id"),
        F.col(secondary).alias("secondary_id"),
        *SUMMARY,
    )


def pair_summary(domain: Domain, kind: str, contributed: DataFrame | None = None) -> DataFrame:
    """All observed pairs of one type: pairs with at least one analysed issue."""
    shared = contributions(domain) if contributed is None else contributed
    if kind == "team-project":
        return _pairs(summarize(team_fact(domain, shared, ("project_id",)), "team_id", "project_id"), kind, "team_id", "project_id")
    if kind == "engineer-project":
        return _pairs(summarize(shared, "engineer_id", "project_id"), kind, "engineer_id", "project_id")
    if kind == "author-project":
        return _pairs(summarize(regroup(shared, carry=("author_id", "project_id")), "author_id", "project_id"), kind, "author_id", "project_id")
    if kind == "team-engineer":
        # A member's issues within the team are the member's own, so the engineer's summary is joined, not recomputed.
        own = summarize(shared, "engineer_id")
        joined = lookup_join(own, domain.members, "engineer_id", "inner", domain.members_are_few)
        return _pairs(joined, kind, "team_id", "engineer_id")
    raise ValueError(f"Unsupported dimension type: {kind}")


def cross_dimensional(domain: Domain) -> DataFrame:
    """All observed pairs of all types; the four rollups share one shuffle of the commits (exchange reuse)."""
    shared = contributions(domain)
    return reduce(DataFrame.unionByName, [pair_summary(domain, kind, shared) for kind in PAIRS])


def one_pair(domain: Domain, kind: str, primary: int, secondary: int) -> DataFrame:
    """One pair, with its filters applied before the rollup; zeros when nothing matches."""
    if kind not in PAIRS:
        raise ValueError(f"Unsupported dimension type: {kind}")
    first, second = (name.lower() for name in PAIRS[kind])
    summary = ai_impact(domain, **{first: primary, second: secondary})
    ids = summary.withColumn("_p", F.lit(primary).cast("bigint")).withColumn("_s", F.lit(secondary).cast("bigint"))
    return _pairs(ids, kind, "_p", "_s")


def cross_dimensional_lookup(
    domain: Domain,
    stored: DataFrame,
    kind: str,
    primary: int,
    secondary: int,
    as_of: datetime,
    max_age_hours: int = 24,
    force: bool = False,
) -> tuple[DataFrame, bool]:
    """The stored row of a pair while fresh, else the pair computed anew; the flag tells which (True: recomputed)."""
    key = f"{kind}:{primary}:{secondary}"
    cutoff = instant(as_of - timedelta(hours=max_age_hours))
    row = stored.where(F.col("dimension_key") == key)
    fresh = row.where(F.col("last_calculated") >= cutoff)
    if not force and not fresh.isEmpty():
        return fresh, False
    return one_pair(domain, kind, primary, secondary).withColumn("last_calculated", instant(as_of)), True


def cross_dimensional_checked(domain: Domain, requests: DataFrame) -> DataFrame:
    """Requested (dimension_type, primary_id, secondary_id) validated one by one; valid pairs carry their metrics.

    An invalid request keeps its row with no metrics, zero issues and the reason.
    """
    known = (
        domain.teams.select(F.lit("Team").alias("kind"), F.col("team_id").alias("entity_id"))
        .unionByName(domain.projects.select(F.lit("Project").alias("kind"), F.col("project_id").alias("entity_id")))
        .unionByName(domain.engineers.select(F.lit("Engineer").alias("kind"), F.col("id").alias("entity_id")))
        .unionByName(domain.engineers.select(F.lit("Author").alias("kind"), F.col("id").alias("entity_id")))
    )

    def entity(position: int) -> Column:
        return reduce(
            lambda chain, item: chain.when(F.col("dimension_type") == item[0], item[1][position]),
            list(PAIRS.items())[1:],
            F.when(F.col("dimension_type") == "team-project", PAIRS["team-project"][position]),
        )

    def existing(prefix: str) -> DataFrame:
        return known.select(
            F.col("kind").alias(f"{prefix}_kind"), F.col("entity_id").alias(f"{prefix}_id"), F.lit(True).alias(f"{prefix}_known")
        )

    checked = (
        requests.withColumn("primary_kind", entity(0))
        .withColumn("secondary_kind", entity(1))
        .join(existing("primary"), ["primary_kind", "primary_id"], "left")
        .join(existing("secondary"), ["secondary_kind", "secondary_id"], "left")
    )
    p, s = F.col("primary_id"), F.col("secondary_id")
    error = (
        F.when(
            F.col("primary_kind").isNull(),
            F.concat(F.lit("Invalid dimension type: "), F.coalesce("dimension_type", F.lit("NULL"))),
        )
        .when(
            p.isNull() | (p <= 0) | s.isNull() | (s <= 0),
            F.concat(
                F.lit("Invalid IDs provided: primary_id="),
                F.coalesce(p.cast("string"), F.lit("NULL")),
                F.lit(", secondary_id="),
                F.coalesce(s.cast("string"), F.lit("NULL")),
            ),
        )
        .when(
            F.col("primary_known").isNull() | F.col("secondary_known").isNull(),
            F.concat_ws(
                " ", "primary_kind", p.cast("string"), F.lit("or"), "secondary_kind", s.cast("string"), F.lit("does not exist")
            ),
        )
    )
    judged = checked.select("dimension_type", p, s, error.alias("error_message"))
    metrics = cross_dimensional(domain).drop("dimension_key")
    joined = judged.join(metrics, ["dimension_type", "primary_id", "secondary_id"], "left")
    valid = F.col("error_message").isNull()
    return joined.select(
        dimension_key(F.col("dimension_type"), p, s).alias("dimension_key"),
        "dimension_type",
        p,
        s,
        F.coalesce(F.when(valid, F.col("total_issues")), F.lit(0)).alias("total_issues"),
        *[F.when(valid, F.coalesce(c, F.lit(0))).alias(c) for c in COUNTS[1:]],
        *[F.when(valid, F.coalesce(c, F.lit(0.0))).alias(c) for c in AVERAGES],
        F.when(valid, "ok").otherwise("error").alias("status"),
        "error_message",
    )


def route(filters: DataFrame) -> DataFrame:
    """Filter requests with the pair type answering them; no type means the general computation.

    A request maps to a pair when exactly two of its four filters are set and a type exists for those two.
    """
    team, project, author, engineer = (F.col(c) for c in ("team_id", "project_id", "author_id", "engineer_id"))
    given = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in (team, project, author, engineer)])

    def usable(*ids: Column) -> Column:
        return reduce(lambda a, b: a & b, [i.isNotNull() & (i != 0) for i in ids], given == 2)

    def choose(a: Column, b: Column, c: Column, d: Column) -> Column:
        return (
            F.when(usable(team, project), a)
            .when(usable(engineer, project), b)
            .when(usable(author, project), c)
            .when(usable(team, engineer), d)
        )

    return filters.withColumns(
        {
            "dimension_type": choose(*[F.lit(kind) for kind in PAIRS]),
            "primary_id": choose(team, engineer, author, team),
            "secondary_id": choose(project, project, project, engineer),
        }
    )


def metric_router(domain: Domain, filters: DataFrame) -> DataFrame:
    """Every request with its metrics: a routed one with its pair's, any other with the general computation's; none are zeros.

    Requests that give the same filters share one computation for all values of these, so there are at most as many as
    there are sets of filters, and each joins its requests by the values.
    """
    routed = route(filters)
    metrics = cross_dimensional(domain).drop("dimension_key")
    pairs = routed.where(F.col("dimension_type").isNotNull()).join(metrics, ["dimension_type", "primary_id", "secondary_id"], "left")
    out = pairs.select(*routed.columns, *SUMMARY)
    general = routed.where(F.col("dimension_type").isNull())
    given = [F.when(F.coalesce(c, F.lit(0)) != 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(FILTERS)]
    general = general.withColumn("_given", reduce(lambda a, b: a + b, given))
    shared = contributions(domain)
    for mask in sorted(r[0] for r in general.select("_given").distinct().collect()):
        names = [c for k, c in enumerate(FILTERS) if mask >> k & 1]
        asked = general.where(F.col("_given") == mask).drop("_given")
        figures = _general(domain, shared, names).toDF(*[f"_{c}" for c in names], *SUMMARY)
        if names:
            matches = reduce(lambda a, b: a & b, [asked[c] == figures[f"_{c}"] for c in names])
            joined = asked.join(figures, matches, "left")
        else:
            joined = asked.select("*", *[figures.select(c).scalar().alias(c) for c in SUMMARY])
        out = out.unionByName(joined.select(*routed.columns, *SUMMARY))
    zeros = {c: F.coalesce(c, F.lit(0)) for c in COUNTS} | {c: F.coalesce(c, F.lit(0.0)) for c in AVERAGES}
    return out.withColumns(zeros).select(*filters.columns, "dimension_type", "primary_id", "secondary_id", *SUMMARY)


# The filters of a request.
FILTERS = ("team_id", "project_id", "author_id", "engineer_id")


def _general(domain: Domain, shared: DataFrame, names: list[str]) -> DataFrame:
    """The impact for all values of some filters: team and engineer choose commits, project and author choose issues."""
    of_commits = [c for c in names if c in ("team_id", "engineer_id")]
    of_issues = [c for c in names if c in ("project_id", "author_id")]
    if not of_commits:
        return summarize(issue_fact(domain), *names).select(*names, *SUMMARY)
    rows = by_team(domain, shared) if "team_id" in names else shared
    return summarize(regroup(rows, *of_commits, carry=of_issues), *names).select(*names, *SUMMARY)
