"""DuckDB SQL for every query of the catalog, written from the definitions rather than from the Spark plans.

All statements share the common tables below; each adds its own tables and a final SELECT.
"""

from __future__ import annotations

BASE = {
    "engineers": "SELECT s_suppkey + 1 AS id, s_name AS name FROM supplier",
    "placed": """
        SELECT s_suppkey, (s_suppkey // 8) * 2 + 1 AS team_id, 'Crew ' AS kind FROM supplier
        UNION ALL
        SELECT s_suppkey, ((s_suppkey + 4) // 8) * 2 + 2, 'Guild ' FROM supplier""",
    "teams": """
        SELECT team_id, kind || CAST(team_id AS VARCHAR) AS team_name,
               string_agg(CAST(s_suppkey + 1 AS VARCHAR), ',' ORDER BY s_suppkey) AS engineer_ids
        FROM placed GROUP BY team_id, kind""",
    "members": "SELECT team_id, CAST(unnest(string_split(engineer_ids, ',')) AS BIGINT) AS engineer_id FROM teams",
    "projects": "SELECT CAST(n_nationkey + 1 AS BIGINT) AS project_id, n_name AS project_name FROM nation",
    "repositories": """
        SELECT p_partkey + 1 AS repo_id, p_partkey % 25 + 1 AS project_id, p_name AS repo_name FROM part""",
    "jira_issues": """
        SELECT o_orderkey + 1 AS issue_id, o_custkey % 25 + 1 AS project_id, o_custkey // 15 + 1 AS author_id,
               CAST(o_orderdate AS DATE) AS creation_date,
               CASE WHEN o_orderstatus <> 'O'
                    THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 + 20 AS INTEGER) END AS resolution_date,
               o_orderpriority AS category
        FROM orders""",
    "commits": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS commit_id, l_suppkey + 1 AS engineer_id,
               l_orderkey + 1 AS jira_issue_id, l_partkey + 1 AS repo_id,
               CAST(o_orderdate AS DATE) + CAST((l_partkey * 7 + l_linenumber) % 45 AS INTEGER) AS commit_date,
               (l_returnflag = 'A' AND l_linestatus = 'F') AS ai_used, CAST(l_quantity AS INTEGER) AS lines_of_code
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
}

AS_OF = "TIMESTAMP '2001-12-31 00:00:00'"
END = "DATE '2001-12-31'"
MARK = "DATE '2000-12-31'"


def sql(select: str, **tables: str) -> str:
    """One statement; of the shared tables it carries those that it uses."""
    tables = {name: body for name, body in tables.items()}
    text = select + " ".join(tables.values())
    needed, grown = [], True
    while grown:
        grown = False
        for name, body in BASE.items():
            if name not in needed and name in text:
                needed.append(name)
                text += body
                grown = True
    parts = [f"{n} AS ({b})" for n, b in BASE.items() if n in needed] + [f"{n} AS ({b})" for n, b in tables.items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


def fact(commits: str = "commits", issues: str = "jira_issues", extra: str = "", key: str = "") -> str:
    """Analysed issues, per further key of the commits if one is named."""
    k = f"{key}, " if key else ""
    return f"""
        SELECT {k}i.issue_id, i.project_id, i.author_id, i.category, i.resolution_date,
               MIN(c.commit_date) AS first_commit_date, COUNT(*) AS total_commits,
               COUNT(CASE WHEN c.ai_used THEN 1 END) AS ai_commits,
               COUNT(CASE WHEN NOT c.ai_used THEN 1 END) AS non_ai_commits,
               CAST(i.resolution_date - MIN(c.commit_date) AS INTEGER) AS cycle_time,
               bool_or(c.ai_used) AS has_ai_commits
        FROM {issues} i JOIN {commits} c ON c.jira_issue_id = i.issue_id
        WHERE i.resolution_date IS NOT NULL {extra}
        GROUP BY {k}i.issue_id, i.project_id, i.author_id, i.category, i.resolution_date"""


TEAM_COMMITS = "SELECT m.team_id, c.* FROM commits c JOIN members m ON m.engineer_id = c.engineer_id"
W = "coalesce(avg(CASE WHEN has_ai_commits THEN cycle_time END), 0)"
WO = "coalesce(avg(CASE WHEN NOT has_ai_commits THEN cycle_time END), 0)"
AVERAGES = f"""
    {W} AS avg_cycle_time_with_ai, {WO} AS avg_cycle_time_without_ai,
    CASE WHEN {WO} > 0 THEN ({WO} - {W}) / {WO} * 100 ELSE 0 END AS cycle_time_impact_percentage,
    coalesce(avg(CASE WHEN has_ai_commits THEN total_commits END), 0) AS avg_commits_with_ai,
    coalesce(avg(CASE WHEN NOT has_ai_commits THEN total_commits END), 0) AS avg_commits_without_ai"""
SUMMARY = f"""
    COUNT(issue_id) AS total_issues, COUNT(CASE WHEN has_ai_commits THEN 1 END) AS issues_with_ai,
    COUNT(CASE WHEN NOT has_ai_commits THEN 1 END) AS issues_without_ai, {AVERAGES}"""
NAMES = (
    "total_issues",
    "issues_with_ai",
    "issues_without_ai",
    "avg_cycle_time_with_ai",
    "avg_cycle_time_without_ai",
    "cycle_time_impact_percentage",
    "avg_commits_with_ai",
    "avg_commits_without_ai",
)


def names(prefix: str = "", rename: str = "") -> str:
    return ", ".join(f"{prefix}{n}" + (f" AS {rename}{n}" if rename else "") for n in NAMES)


def per_entity(entities: str, key: str, fact_sql: str, extra: str = "", more: str = "", **tables: str) -> str:
    """A summary row for every entity of a SELECT with the key, zeros included."""
    return sql(
        f"SELECT e.* {extra}, {SUMMARY} {more} FROM entities e LEFT JOIN f ON f.{key} = e.{key} GROUP BY ALL",
        **tables,
        f=fact_sql,
        entities=entities,
    )


SCORE = f"""least(100.0, greatest(0.0, s.cycle_time_impact_percentage * 0.7 + CASE WHEN s.avg_commits_without_ai > 0
    THEN s.avg_commits_with_ai / s.avg_commits_without_ai ELSE 1 END * 30))"""


def scored(entities: str, key: str, fact_sql: str, tail: str = "", stamp: str = "") -> str:
    return sql(
        f"SELECT s.*, {SCORE} AS efficiency_score{', ' * bool(stamp)}{stamp} FROM s {tail}",
        f=fact_sql,
        entities=entities,
        s=f"SELECT e.{key}, {SUMMARY} FROM entities e LEFT JOIN f ON f.{key} = e.{key} GROUP BY e.{key}",
    )


ENGINEER_FACT = fact(key="c.engineer_id")
TEAM_FACT = fact(commits="tc", key="c.team_id")

ORACLES: dict[str, str] = {}
Q = ORACLES

FACT_COLUMNS = """issue_id, project_id, author_id, category, total_commits, ai_commits, non_ai_commits, cycle_time,
    has_ai_commits"""
Q["issue_fact"] = sql(f"SELECT {FACT_COLUMNS}, first_commit_date FROM f", f=fact())
Q["ai_impact"] = sql(f"SELECT {SUMMARY} FROM f", f=fact())
Q["ai_impact_of_project"] = sql(f"SELECT {SUMMARY} FROM f", f=fact(extra="AND i.project_id = 1"))
Q["ai_impact_of_author"] = sql(f"SELECT {SUMMARY} FROM f", f=fact(extra="AND i.author_id = 1"))
Q["ai_impact_of_engineer"] = sql(f"SELECT {SUMMARY} FROM f", f=fact(extra="AND c.engineer_id = 1"))
Q["ai_impact_of_team"] = sql(
    f"SELECT {SUMMARY} FROM f",
    f=fact(extra="AND c.engineer_id IN (SELECT engineer_id FROM members WHERE team_id = 1)"),
)
Q["category_stats"] = sql(
    """SELECT category, has_ai_commits, COUNT(*) AS issue_count, CAST(SUM(cycle_time) AS BIGINT) AS total_cycle_time,
              AVG(cycle_time) AS avg_cycle_time FROM f GROUP BY category, has_ai_commits""",
    f=fact(),
)
Q["issue_detail"] = sql(
    """SELECT engineer_id, has_ai_commits, issue_id, cycle_time, total_commits, ai_commits, non_ai_commits, category
       FROM f""",
    f=ENGINEER_FACT,
)
Q["issue_detail_pages"] = sql(
    """SELECT project_id, has_ai_commits, issue_id // 1000 AS page,
              string_agg(CAST(issue_id AS VARCHAR), ',' ORDER BY issue_id) AS issue_ids,
              CAST(SUM(cycle_time) AS BIGINT) AS cycle_days
       FROM f GROUP BY project_id, has_ai_commits, issue_id // 1000""",
    f=fact(),
)

Q["impact_document"] = sql(
    f"""SELECT s.total_issues AS "totalIssuesAnalyzed", s.cycle_time_impact_percentage AS "cycleTimeImpactPercentage",
               has_ai_commits, category, COUNT(*) AS count, CAST(SUM(cycle_time) AS BIGINT) AS "totalCycleTime",
               AVG(cycle_time) AS "avgCycleTime"
        FROM f, s GROUP BY ALL""",
    f=fact(),
    s=f"SELECT {SUMMARY} FROM f",
)

TEAMS_SIZED = "SELECT team_id, team_name, CAST(len(string_split(engineer_ids, ',')) AS INTEGER) AS engineer_count FROM teams"
Q["team_metrics"] = per_entity(TEAMS_SIZED, "team_id", TEAM_FACT, tc=TEAM_COMMITS)
Q["engineer_metrics"] = per_entity(
    "SELECT id AS engineer_id, name AS engineer_name FROM engineers", "engineer_id", ENGINEER_FACT
)
Q["project_metrics"] = per_entity("SELECT project_id, project_name FROM projects", "project_id", fact())


def shares(key: str) -> str:
    return f"""
        SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY COUNT(*) DESC, category) AS rank, category,
               COUNT(*) AS issue_count,
               CAST(COUNT(CASE WHEN has_ai_commits THEN 1 END) AS DOUBLE) / COUNT(*) * 100 AS ai_percentage
        FROM f GROUP BY {key}, category"""


RANKED = "CAST(rank AS INTEGER) AS rank, category, issue_count, ai_percentage"
Q["top_categories"] = sql(
    f"SELECT team_id, {RANKED} FROM ranked WHERE rank <= 5", tc=TEAM_COMMITS, f=TEAM_FACT, ranked=shares("team_id")
)
ADOPTION = "CASE WHEN total_issues > 0 THEN CAST(issues_with_ai AS DOUBLE) / total_issues ELSE 0 END AS ai_adoption_rate"
TEAM_SUMMARY = f"SELECT t.*, {SUMMARY} FROM sized t LEFT JOIN f ON f.team_id = t.team_id GROUP BY ALL"
Q["team_metrics_materialized"] = sql(
    f"""SELECT s.*, {ADOPTION}, coalesce(c.top_categories, '') AS top_categories, {AS_OF} AS last_calculated
        FROM s LEFT JOIN cats c ON c.team_id = s.team_id""",
    tc=TEAM_COMMITS,
    f=TEAM_FACT,
    sized=TEAMS_SIZED,
    s=TEAM_SUMMARY,
    ranked=shares("team_id"),
    cats="""SELECT team_id, string_agg(category || ':' || CAST(issue_count AS VARCHAR), ',' ORDER BY rank) AS top_categories
            FROM ranked WHERE rank <= 5 GROUP BY team_id""",
)
Q["team_metrics_with_categories"] = sql(
    f"""SELECT s.* EXCLUDE (team_name, engineer_count), {ADOPTION}, CAST(r.rank AS INTEGER) AS rank, r.category,
               r.issue_count, r.ai_percentage
        FROM s LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) r ON r.team_id = s.team_id""",
    tc=TEAM_COMMITS,
    f=TEAM_FACT,
    sized=TEAMS_SIZED,
    s=TEAM_SUMMARY,
    ranked=shares("team_id"),
)
Q["engineer_metrics_scored"] = scored("SELECT DISTINCT engineer_id FROM commits", "engineer_id", ENGINEER_FACT)
Q["engineer_metrics_page"] = per_entity(
    "SELECT id AS engineer_id, name AS engineer_name FROM engineers ORDER BY id LIMIT 25 OFFSET 50",
    "engineer_id",
    ENGINEER_FACT,
)
Q["project_metrics_materialized"] = per_entity(
    "SELECT DISTINCT project_id FROM jira_issues", "project_id", fact(), more=f", {AS_OF} AS last_calculated"
)
AUTHORS = "SELECT DISTINCT author_id FROM jira_issues"
Q["author_metrics"] = scored(AUTHORS, "author_id", fact())
Q["author_page"] = scored(AUTHORS, "author_id", fact(), "ORDER BY author_id LIMIT 20 OFFSET 10")
Q["author_page_after"] = scored(AUTHORS, "author_id", fact(), "WHERE author_id > 30 ORDER BY author_id LIMIT 20")
Q["author_metrics_as_engineer"] = scored(
    AUTHORS, "author_id", f"SELECT * REPLACE (engineer_id AS author_id) FROM ({ENGINEER_FACT})"
)
Q["category_metrics"] = per_entity("SELECT DISTINCT category FROM jira_issues", "category", fact())

# -- cycle time
ROLLED = """SELECT jira_issue_id, MIN(commit_date) AS first_commit_date, COUNT(*) AS total_commits,
    COUNT(CASE WHEN ai_used THEN 1 END) AS ai_commits, bool_or(ai_used) AS assisted FROM commits GROUP BY jira_issue_id"""
CYCLE = """SELECT issue_id,
    CASE WHEN message IS NULL THEN greatest(0, CAST(resolution_date - first_commit_date AS INTEGER)) END AS cycle_time,
    CASE WHEN message IS NULL THEN first_commit_date END AS first_commit_date,
    CASE WHEN message IS NULL THEN resolution_date END AS resolution_date,
    CASE WHEN message IS NULL THEN total_commits END AS total_commits,
    CASE WHEN message IS NULL THEN ai_commits END AS ai_commits,
    CASE WHEN message IS NULL THEN total_commits - ai_commits END AS non_ai_commits,
    CASE WHEN message IS NULL THEN CAST(ai_commits AS DOUBLE) / total_commits END AS ai_usage_ratio, message
    FROM (SELECT *, CASE WHEN resolution_date IS NULL THEN 'Issue not found or has not been resolved'
                         WHEN total_commits IS NULL THEN 'No commits found for this issue' END AS message
          FROM jira_issues LEFT JOIN rolled ON jira_issue_id = issue_id)"""
Q["issue_cycle_time"] = sql("SELECT * FROM cycle", rolled=ROLLED, cycle=CYCLE)
Q["all_issue_cycle_times"] = sql(
    "SELECT * EXCLUDE (message) FROM cycle WHERE cycle_time IS NOT NULL", rolled=ROLLED, cycle=CYCLE
)
Q["average_cycle_time"] = sql(
    "SELECT coalesce(avg(cycle_time), 0) AS avg_cycle_time FROM cycle", rolled=ROLLED, cycle=CYCLE
)
Q["cycle_time_summary"] = sql(
    """SELECT CASE WHEN assisted THEN 'ai_assisted' ELSE 'non_ai_assisted' END AS assistance_type,
              COUNT(issue_id) AS issue_count, AVG(days) AS avg_cycle_time_days,
              CAST(quantile_cont(days, 0.5) AS DOUBLE) AS median_cycle_time_days,
              MIN(days) AS min_cycle_time_days, MAX(days) AS max_cycle_time_days
       FROM (SELECT *, CAST(resolution_date - first_commit_date AS INTEGER) AS days
             FROM jira_issues JOIN rolled ON jira_issue_id = issue_id)
       GROUP BY 1""",
    rolled=ROLLED,
)
Q["first_commit"] = sql(
    """SELECT jira_issue_id AS issue_id, commit_id, commit_date FROM commits
       QUALIFY row_number() OVER (PARTITION BY jira_issue_id ORDER BY commit_date, commit_id) = 1"""
)

# -- time
Q["timeline_adoption"] = sql(
    """SELECT c.month, c.total_commits, c.ai_commits, coalesce(r.resolved_issues, 0) AS resolved_issues,
              CASE WHEN r.resolved_issues > 0 THEN r.total // r.resolved_issues ELSE 0 END AS avg_cycle_time,
              CAST(c.ai_commits AS DOUBLE) / c.total_commits * 100 AS ai_adoption_rate
       FROM (SELECT strftime(commit_date, '%Y-%m') AS month, COUNT(*) AS total_commits,
                    COUNT(CASE WHEN ai_used THEN 1 END) AS ai_commits FROM commits GROUP BY 1) c
       LEFT JOIN (SELECT strftime(resolution_date, '%Y-%m') AS month, COUNT(*) AS resolved_issues,
                         CAST(SUM(cycle_time) AS BIGINT) AS total FROM f GROUP BY 1) r ON r.month = c.month""",
    f=fact(),
)


def periods(step: str = "1 MONTH") -> str:
    return f"""SELECT MIN(commit_date) AS time_period FROM commits
        UNION ALL SELECT CAST(time_period + INTERVAL {step} AS DATE) FROM p
        WHERE CAST(time_period + INTERVAL {step} AS DATE) <= {END}"""


def bounded(step: str = "1 MONTH") -> str:
    return f"SELECT time_period, CAST(time_period + INTERVAL {step} - INTERVAL 1 DAY AS DATE) AS period_end FROM p"


PC = """SELECT p.time_period, c.jira_issue_id, MIN(commit_date) AS first_commit_date, COUNT(*) AS n, bool_or(ai_used) AS ai
        FROM pb p JOIN commits c ON c.commit_date BETWEEN p.time_period AND p.period_end GROUP BY ALL"""
PI = """SELECT pc.time_period, i.issue_id, i.category, pc.ai AS has_ai_commits,
               CAST(i.resolution_date - pc.first_commit_date AS INTEGER) AS cycle_time
        FROM pc JOIN pb ON pb.time_period = pc.time_period JOIN jira_issues i ON i.issue_id = pc.jira_issue_id
        WHERE i.resolution_date BETWEEN pb.time_period AND pb.period_end"""
PERIOD_SUMMARY = f"""SELECT pb.time_period, COUNT(issue_id) AS total_issues,
        COUNT(CASE WHEN has_ai_commits THEN 1 END) AS ai_assisted_issues,
        COUNT(CASE WHEN NOT has_ai_commits THEN 1 END) AS non_ai_assisted_issues,
        {W} AS avg_cycle_time_with_ai, {WO} AS avg_cycle_time_without_ai,
        CASE WHEN {WO} > 0 THEN ({WO} - {W}) / {WO} * 100 ELSE 0 END AS cycle_time_impact_percentage,
        CASE WHEN COUNT(issue_id) > 0
             THEN CAST(COUNT(CASE WHEN has_ai_commits THEN 1 END) AS DOUBLE) / COUNT(issue_id) * 100 ELSE 0 END
             AS ai_adoption_percentage
        FROM pb LEFT JOIN pi ON pi.time_period = pb.time_period GROUP BY pb.time_period"""


def timeline(select: str, step: str = "1 MONTH", **tables: str) -> str:
    return sql(select, p=periods(step), pb=bounded(step), pc=PC, **tables)


Q["timeline_periods"] = timeline(PERIOD_SUMMARY, pi=PI)
Q["timeline_periods_weekly"] = timeline(PERIOD_SUMMARY, "7 DAY", pi=PI)
Q["timeline_read_weekly"] = Q["timeline_periods_weekly"]
Q["timeline_top_categories"] = timeline(
    f"SELECT time_period, {RANKED} FROM ranked WHERE rank <= 5", f=PI, ranked=shares("time_period")
)
REPOS = """SELECT p.time_period, row_number() OVER (PARTITION BY p.time_period ORDER BY COUNT(*) DESC, repo_id) AS rank,
                  repo_id, COUNT(*) AS commit_count,
                  CAST(COUNT(CASE WHEN ai_used THEN 1 END) AS DOUBLE) / COUNT(*) * 100 AS ai_percentage
           FROM pb p JOIN commits c ON c.commit_date BETWEEN p.time_period AND p.period_end GROUP BY p.time_period, repo_id"""
Q["top_repositories"] = timeline(
    "SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM repos WHERE rank <= 5", repos=REPOS
)
Q["timeline_commit_volume"] = timeline(
    """SELECT pb.time_period, (SELECT COUNT(*) FROM jira_issues) AS total_issues,
              COUNT(CASE WHEN ai THEN 1 END) AS ai_assisted_issues,
              COUNT(CASE WHEN NOT ai THEN 1 END) AS non_ai_assisted_issues,
              coalesce(avg(CASE WHEN ai THEN n END), 0) AS avg_cycle_time_with_ai,
              coalesce(avg(CASE WHEN NOT ai THEN n END), 0) AS avg_cycle_time_without_ai,
              coalesce((avg(CASE WHEN ai THEN n END) / nullif(avg(CASE WHEN NOT ai THEN n END), 0) - 1) * 100, 0)
                  AS cycle_time_impact_percentage,
              CAST(COUNT(CASE WHEN ai THEN 1 END) AS DOUBLE) / (SELECT COUNT(*) FROM jira_issues) * 100
                  AS ai_adoption_percentage
       FROM pb LEFT JOIN pc ON pc.time_period = pb.time_period GROUP BY pb.time_period"""
)
CI = """SELECT pc.time_period, i.issue_id, pc.ai AS has_ai_commits,
               CAST(i.resolution_date - i.creation_date AS INTEGER) AS cycle_time
        FROM pc JOIN jira_issues i ON i.issue_id = pc.jira_issue_id"""
AW, AWO = "avg(CASE WHEN has_ai_commits THEN cycle_time END)", "avg(CASE WHEN NOT has_ai_commits THEN cycle_time END)"
Q["timeline_creation_to_resolution"] = timeline(
    PERIOD_SUMMARY.replace(
        f"CASE WHEN {WO} > 0 THEN ({WO} - {W}) / {WO} * 100 ELSE 0 END",
        f"coalesce(CASE WHEN {AWO} > 0 THEN ({AWO} - {AW}) / {AWO} * 100 ELSE 0 END, 0)",
    ),
    pi=CI,
)
Q["timeline_read"] = timeline(
    """SELECT s.*, pb.period_end, 'month' AS interval,
              coalesce(CAST(k.n AS INTEGER), NULL) AS category_count, r.repo_id AS busiest_repo
       FROM s JOIN pb ON pb.time_period = s.time_period
       LEFT JOIN (SELECT time_period, least(COUNT(*), 5) AS n FROM ranked GROUP BY 1) k ON k.time_period = s.time_period
       LEFT JOIN (SELECT * FROM repos WHERE rank = 1) r ON r.time_period = s.time_period
       WHERE s.time_period BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'""",
    pi=PI,
    f=PI,
    ranked=shares("time_period"),
    repos=REPOS,
    s=PERIOD_SUMMARY,
)
Q["period_table"] = sql(
    "SELECT time_period AS period_start, period_end FROM pb", p=periods(), pb=bounded()
)

# -- pairs
PAIR = f"""
    SELECT 'team-project' AS dimension_type, team_id AS primary_id, project_id AS secondary_id, {SUMMARY}
    FROM tf GROUP BY 2, 3
    UNION ALL
    SELECT 'engineer-project', engineer_id, project_id, {SUMMARY} FROM ef GROUP BY 2, 3
    UNION ALL
    SELECT 'author-project', author_id, project_id, {SUMMARY} FROM f GROUP BY 2, 3
    UNION ALL
    SELECT 'team-engineer', team_id, engineer_id, {SUMMARY} FROM tef GROUP BY 2, 3"""
PAIR_KEY = "dimension_type || ':' || CAST(primary_id AS VARCHAR) || ':' || CAST(secondary_id AS VARCHAR) AS dimension_key"


def pairs(select: str, **tables: str) -> str:
    return sql(
        select,
        tc=TEAM_COMMITS,
        f=fact(),
        ef=ENGINEER_FACT,
        tf=TEAM_FACT,
        tef=fact(commits="tc", key="c.team_id, c.engineer_id"),
        pairs=PAIR,
        **tables,
    )


Q["cross_dimensional"] = pairs(f"SELECT {PAIR_KEY}, pairs.* FROM pairs")
Q["cross_dimensional_lookup"] = sql(
    f"""SELECT 'team-project:1:1' AS dimension_key, 'team-project' AS dimension_type, CAST(1 AS BIGINT) AS primary_id,
               CAST(1 AS BIGINT) AS secondary_id, {SUMMARY}, {AS_OF} AS last_calculated FROM f""",
    f=fact(extra="AND i.project_id = 1 AND c.engineer_id IN (SELECT engineer_id FROM members WHERE team_id = 1)"),
)
CHECKED = """
    SELECT *, CASE
        WHEN pk IS NULL THEN 'Invalid dimension type: ' || dimension_type
        WHEN primary_id <= 0 OR secondary_id <= 0
        THEN 'Invalid IDs provided: primary_id=' || primary_id || ', secondary_id=' || secondary_id
        WHEN NOT p_known OR NOT s_known
        THEN pk || ' ' || primary_id || ' or ' || sk || ' ' || secondary_id || ' does not exist' END AS error_message
    FROM (SELECT *, CASE pk WHEN 'Team' THEN primary_id IN (SELECT team_id FROM teams)
                            ELSE primary_id IN (SELECT id FROM engineers) END AS p_known,
                    CASE sk WHEN 'Project' THEN secondary_id IN (SELECT project_id FROM projects)
                            ELSE secondary_id IN (SELECT id FROM engineers) END AS s_known
          FROM requests)"""
Q["cross_dimensional_checked"] = pairs(
    f"""SELECT c.dimension_type || ':' || c.primary_id || ':' || c.secondary_id AS dimension_key, c.dimension_type,
               c.primary_id, c.secondary_id,
               coalesce(CASE WHEN error_message IS NULL THEN total_issues END, 0) AS total_issues,
               {", ".join(f"CASE WHEN error_message IS NULL THEN coalesce({n}, 0) END AS {n}" for n in NAMES[1:])},
               CASE WHEN error_message IS NULL THEN 'ok' ELSE 'error' END AS status, error_message
        FROM checked c LEFT JOIN pairs USING (dimension_type, primary_id, secondary_id)""",
    requests="""SELECT c_custkey AS primary_id, CAST(c_nationkey AS BIGINT) AS secondary_id,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'team-project' WHEN 'AUTOMOBILE' THEN 'engineer-project'
            WHEN 'MACHINERY' THEN 'author-project' WHEN 'HOUSEHOLD' THEN 'team-engineer' ELSE 'team-category' END
            AS dimension_type,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'Team' WHEN 'AUTOMOBILE' THEN 'Engineer'
            WHEN 'MACHINERY' THEN 'Author' WHEN 'HOUSEHOLD' THEN 'Team' END AS pk,
        CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Engineer' ELSE 'Project' END AS sk
        FROM customer""",
    checked=CHECKED,
)
Q["metric_router"] = pairs(
    f"""SELECT r.request_id, r.team_id, r.project_id, r.author_id, r.engineer_id, r.dimension_type, r.primary_id,
               r.secondary_id,
               {", ".join(f"coalesce(CASE WHEN r.dimension_type IS NOT NULL THEN p.{n} ELSE g.{n} END, 0) AS {n}" for n in NAMES)}
        FROM routed r LEFT JOIN pairs p USING (dimension_type, primary_id, secondary_id)
        LEFT JOIN general g ON r.dimension_type IS NULL AND g.project_id = r.project_id""",
    # What no pair answers asks for a project alone.
    general=f"SELECT f.project_id, {SUMMARY} FROM f GROUP BY f.project_id",
    wanted="""SELECT c_custkey AS request_id,
        CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN CAST(c_nationkey + 1 AS BIGINT) END AS team_id,
        CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN CAST(c_nationkey + 1 AS BIGINT) END AS project_id,
        CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN c_custkey + 1 END AS author_id,
        CASE WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN c_custkey + 1 END AS engineer_id FROM customer""",
    routed="""SELECT *, CASE WHEN team_id IS NOT NULL AND project_id IS NOT NULL THEN 'team-project'
            WHEN engineer_id IS NOT NULL AND project_id IS NOT NULL THEN 'engineer-project'
            WHEN author_id IS NOT NULL AND project_id IS NOT NULL THEN 'author-project'
            WHEN team_id IS NOT NULL AND engineer_id IS NOT NULL THEN 'team-engineer' END AS dimension_type,
        CASE WHEN team_id IS NOT NULL AND project_id IS NOT NULL THEN team_id
            WHEN engineer_id IS NOT NULL AND project_id IS NOT NULL THEN engineer_id
            WHEN author_id IS NOT NULL AND project_id IS NOT NULL THEN author_id
            WHEN team_id IS NOT NULL AND engineer_id IS NOT NULL THEN team_id END AS primary_id,
        CASE WHEN project_id IS NOT NULL AND coalesce(team_id, engineer_id, author_id) IS NOT NULL THEN project_id
            WHEN team_id IS NOT NULL AND engineer_id IS NOT NULL THEN engineer_id END AS secondary_id FROM wanted""",
)
Q["metric_router_general"] = sql(
    f"""SELECT w.request_id, w.team_id, w.project_id, w.author_id, w.engineer_id, CAST(NULL AS VARCHAR) AS dimension_type,
               CAST(NULL AS BIGINT) AS primary_id, CAST(NULL AS BIGINT) AS secondary_id, {SUMMARY}
        FROM wanted w LEFT JOIN f USING (request_id) GROUP BY w.request_id, w.team_id, w.project_id, w.author_id, w.engineer_id""",
    wanted="""SELECT c_custkey AS request_id,
        CASE WHEN c_custkey % 8 IN (1, 5, 7) THEN c_custkey % 20 + 1 WHEN c_custkey % 8 = 6 THEN 0 END AS team_id,
        CASE WHEN c_custkey % 8 IN (2, 5, 6, 7) THEN c_custkey % 25 + 1 END AS project_id,
        CASE WHEN c_custkey % 8 IN (3, 7) THEN c_custkey % 90 + 1 END AS author_id,
        CASE WHEN c_custkey % 8 IN (4, 5, 7) THEN c_custkey % 30 + 1 END AS engineer_id FROM customer""",
    crews="SELECT engineer_id, list(team_id) AS teams FROM members GROUP BY engineer_id",
    per_engineer="""SELECT i.issue_id, i.project_id, i.author_id, i.resolution_date, c.engineer_id, k.teams,
        MIN(c.commit_date) AS first_commit_date, COUNT(*) AS n, COUNT(CASE WHEN c.ai_used THEN 1 END) AS ai
        FROM jira_issues i JOIN commits c ON c.jira_issue_id = i.issue_id LEFT JOIN crews k ON k.engineer_id = c.engineer_id
        WHERE i.resolution_date IS NOT NULL GROUP BY ALL""",
    f="""SELECT w.request_id, e.issue_id, SUM(n) AS total_commits, SUM(ai) AS ai_commits, SUM(ai) > 0 AS has_ai_commits,
        CAST(e.resolution_date - MIN(first_commit_date) AS INTEGER) AS cycle_time
        FROM wanted w JOIN per_engineer e ON (coalesce(w.project_id, 0) = 0 OR w.project_id = e.project_id)
             AND (coalesce(w.author_id, 0) = 0 OR w.author_id = e.author_id)
             AND (coalesce(w.engineer_id, 0) = 0 OR w.engineer_id = e.engineer_id)
             AND (coalesce(w.team_id, 0) = 0 OR list_contains(e.teams, w.team_id))
        GROUP BY w.request_id, e.issue_id, e.resolution_date""",
)

# -- stored facts
ALL_TEAMS = "SELECT c.*, m.team_id FROM commits c LEFT JOIN members m ON m.engineer_id = c.engineer_id"
FIRST_TEAM = """SELECT c.*, m.team_id FROM commits c
    LEFT JOIN (SELECT engineer_id, MIN(team_id) AS team_id FROM members GROUP BY 1) m ON m.engineer_id = c.engineer_id"""


def with_teams(commits: str, extra: str = "", distinct: str = "", label: str = "team_ids") -> str:
    return f"""
        SELECT i.issue_id, i.project_id, i.author_id, i.category, COUNT({distinct} c.row) AS total_commits,
               COUNT({distinct} CASE WHEN c.ai_used THEN c.row END) AS ai_commits,
               COUNT({distinct} CASE WHEN NOT c.ai_used THEN c.row END) AS non_ai_commits,
               CAST(i.resolution_date - MIN(c.commit_date) AS INTEGER) AS cycle_time,
               bool_or(c.ai_used) AS has_ai_commits,
               array_to_string(list_sort(list(DISTINCT c.team_id)), ',') AS {label}
        FROM jira_issues i JOIN ({commits}) c ON c.jira_issue_id = i.issue_id
        WHERE i.resolution_date IS NOT NULL {extra}
        GROUP BY i.issue_id, i.project_id, i.author_id, i.category, i.resolution_date"""


NUMBERED = "(SELECT *, row_number() OVER () AS row FROM commits)"
ALL_N, FIRST_N = ALL_TEAMS.replace("FROM commits c", f"FROM {NUMBERED} c"), FIRST_TEAM.replace("FROM commits c", f"FROM {NUMBERED} c")
Q["ai_impact_base"] = sql(with_teams(ALL_N))
Q["ai_impact_base_deduplicated"] = sql(with_teams(ALL_N, distinct="DISTINCT"))
STORED_SUMMARY = with_teams(FIRST_N)
Q["ai_impact_summary"] = sql(f"SELECT *, {AS_OF} AS last_updated FROM s", s=STORED_SUMMARY)
Q["summary_full_refresh"] = Q["ai_impact_summary"]
Q["stream_incremental_summary"] = Q["ai_impact_summary"]
CHANGED_SUMMARY = sql(
    f"""SELECT s.*, CASE WHEN n.jira_issue_id IS NULL THEN TIMESTAMP '2000-12-31 00:00:00' ELSE {AS_OF} END AS last_updated
        FROM s LEFT JOIN (SELECT DISTINCT jira_issue_id FROM commits WHERE commit_date > {MARK}) n
        ON n.jira_issue_id = s.issue_id""",
    s=STORED_SUMMARY,
)
Q["ai_impact_incremental"] = CHANGED_SUMMARY
Q["summary_merge"] = CHANGED_SUMMARY
Q["ai_impact_view"] = sql(STORED_SUMMARY)
NULL_IMPACT = f"""SELECT COUNT(*) AS total_issues, COUNT(CASE WHEN has_ai_commits THEN 1 END) AS issues_with_ai,
    COUNT(CASE WHEN NOT has_ai_commits THEN 1 END) AS issues_without_ai, {W} AS avg_cycle_time_with_ai,
    {WO} AS avg_cycle_time_without_ai,
    CASE WHEN {AWO} > 0 THEN ({AWO} - {AW}) / {AWO} * 100 ELSE 0 END AS cycle_time_impact_percentage,
    coalesce(avg(CASE WHEN has_ai_commits THEN total_commits END), 0) AS avg_commits_with_ai,
    coalesce(avg(CASE WHEN NOT has_ai_commits THEN total_commits END), 0) AS avg_commits_without_ai"""
Q["ai_impact_from_summary"] = sql(f"{NULL_IMPACT} FROM s", s=STORED_SUMMARY)
Q["ai_impact_from_summary_of_engineer"] = sql(
    f"{NULL_IMPACT} FROM s WHERE issue_id IN (SELECT jira_issue_id FROM commits WHERE engineer_id = 1)", s=STORED_SUMMARY
)
Q["ai_impact_from_summary_by_author"] = sql(
    f"{NULL_IMPACT}, author_id, project_id FROM s GROUP BY author_id, project_id", s=STORED_SUMMARY
)
Q["issues_of_team"] = sql(
    f"SELECT * FROM s WHERE list_contains(string_split(team_ids, ','), '1')", s=with_teams(ALL_N)
)
Q["issue_commits"] = sql(
    """SELECT issue_id, category, creation_date, resolution_date, commit_id, commit_date, ai_used
       FROM jira_issues JOIN commits ON jira_issue_id = issue_id"""
)
Q["commit_teams_all"] = sql("SELECT commit_id, engineer_id, commit_date, ai_used, team_id FROM a", a=ALL_TEAMS)
Q["commit_teams_first"] = sql("SELECT commit_id, engineer_id, commit_date, ai_used, team_id FROM a", a=FIRST_TEAM)

# -- refresh
OLD_END, STALE_END, STALE_FROM = "DATE '1995-06-30'", "DATE '2001-06-30'", "TIMESTAMP '2001-06-25 00:00:00'"


def engineer_rows(commits: str) -> str:
    return f"""SELECT k.engineer_id, {SUMMARY} FROM (SELECT DISTINCT engineer_id FROM {commits}) k
        LEFT JOIN ({fact(commits=commits, key="c.engineer_id")}) f ON f.engineer_id = k.engineer_id GROUP BY k.engineer_id"""


Q["metrics_upsert"] = sql(
    f"""SELECT *, {AS_OF} AS last_calculated FROM newer WHERE engineer_id IN (SELECT engineer_id FROM touched)
        UNION ALL
        SELECT *, TIMESTAMP '2000-12-31 00:00:00' FROM older
        WHERE engineer_id NOT IN (SELECT engineer_id FROM touched)""",
    old_commits=f"SELECT * FROM commits WHERE commit_date <= {OLD_END}",
    touched="SELECT DISTINCT engineer_id FROM commits WHERE commit_date > DATE '2001-08-01'",
    older=engineer_rows("old_commits"),
    newer=engineer_rows("commits"),
)
Q["metrics_lookup"] = sql(
    f"SELECT *, {AS_OF} AS last_calculated FROM r WHERE engineer_id = 1", r=engineer_rows("commits")
)
TOUCHED = """
    SELECT 'team' AS dimension, CAST(m.team_id AS VARCHAR) AS entity_key, MAX(commit_date) AS day
    FROM {c} c JOIN members m ON m.engineer_id = c.engineer_id GROUP BY 2
    UNION ALL SELECT 'engineer', CAST(engineer_id AS VARCHAR), MAX(commit_date) FROM {c} GROUP BY 2
    UNION ALL SELECT 'project', CAST(project_id AS VARCHAR), MAX(commit_date)
    FROM {c} JOIN jira_issues ON issue_id = jira_issue_id GROUP BY 2
    UNION ALL SELECT 'category', category, MAX(commit_date) FROM {c} JOIN jira_issues ON issue_id = jira_issue_id GROUP BY 2"""
OWNERS = """
    SELECT 'team' AS dimension, CAST(team_id AS VARCHAR) AS entity_key FROM teams
    UNION SELECT 'engineer', CAST(engineer_id AS VARCHAR) FROM commits
    UNION SELECT 'project', CAST(project_id AS VARCHAR) FROM jira_issues
    UNION SELECT 'category', category FROM jira_issues"""
STALE = f"""SELECT o.dimension, o.entity_key FROM owners o LEFT JOIN touched t USING (dimension, entity_key)
    WHERE t.day IS NULL OR t.day < {STALE_FROM}"""
EARLIER = f"SELECT * FROM commits WHERE commit_date <= {STALE_END}"
Q["stale_entities"] = sql(STALE, earlier=EARLIER, touched=TOUCHED.format(c="earlier"), owners=OWNERS)
Q["affected_entities"] = sql(
    "SELECT dimension, entity_key FROM t",
    late="SELECT * FROM commits WHERE commit_date > DATE '2001-09-01'",
    t=TOUCHED.format(c="late"),
)
Q["changed_issues"] = sql(
    f"""SELECT n.* FROM jira_issues n LEFT JOIN before b ON b.issue_id = n.issue_id
        WHERE b.issue_id IS NULL OR n.resolution_date IS DISTINCT FROM b.resolution_date
           OR n.project_id IS DISTINCT FROM b.project_id OR n.category IS DISTINCT FROM b.category""",
    before=f"""SELECT * REPLACE (CASE WHEN resolution_date <= {MARK} THEN resolution_date END AS resolution_date)
               FROM jira_issues WHERE creation_date <= {MARK}""",
)


def all_rows(commits: str) -> str:
    team = f"SELECT m.team_id, c.* FROM {commits} c JOIN members m ON m.engineer_id = c.engineer_id"
    return f"""
        SELECT 'team' AS dimension, CAST(t.team_id AS VARCHAR) AS entity_key, {SUMMARY} FROM teams t
        LEFT JOIN ({fact(commits=f"({team})", key="c.team_id")}) f ON f.team_id = t.team_id GROUP BY t.team_id
        UNION ALL SELECT 'engineer', CAST(engineer_id AS VARCHAR), {names()} FROM ({engineer_rows(commits)})
        UNION ALL SELECT 'project', CAST(k.project_id AS VARCHAR), {SUMMARY} FROM
        (SELECT DISTINCT project_id FROM jira_issues) k
        LEFT JOIN ({fact(commits=commits)}) f ON f.project_id = k.project_id GROUP BY k.project_id
        UNION ALL SELECT 'category', k.category, {SUMMARY} FROM
        (SELECT DISTINCT category FROM jira_issues) k
        LEFT JOIN ({fact(commits=commits)}) f ON f.category = k.category GROUP BY k.category"""


Q["refresh_all_metrics"] = sql(
    f"""SELECT dimension, entity_key, {names("x.")},
               CASE WHEN late THEN TIMESTAMP '2001-06-26 00:00:00' ELSE CAST(s.day AS TIMESTAMP) END AS last_calculated
        FROM (SELECT *, TRUE AS late FROM newer UNION ALL SELECT *, FALSE FROM older) x JOIN state s USING (dimension, entity_key)
        WHERE late = s.stale""",
    earlier=EARLIER,
    touched=TOUCHED.format(c="earlier"),
    owners=OWNERS,
    state=f"""SELECT o.dimension, o.entity_key, t.day, t.day IS NULL OR t.day < {STALE_FROM} AS stale
              FROM owners o LEFT JOIN touched t USING (dimension, entity_key)""",
    older=all_rows("earlier"),
    newer=all_rows("commits"),
)
Q["refresh_report"] = sql(
    "SELECT dimension, COUNT(*) AS processed, COUNT(*) AS total, CAST(0 AS BIGINT) AS failed FROM owners GROUP BY dimension",
    owners=OWNERS + " UNION SELECT 'author', CAST(author_id AS VARCHAR) FROM jira_issues",
)
STAMP = f"{AS_OF} AS last_calculated"
Q["current_team_metrics"] = sql(
    f"SELECT s.* EXCLUDE (team_name, engineer_count), {ADOPTION}, {STAMP} FROM s",
    tc=TEAM_COMMITS,
    f=TEAM_FACT,
    sized=TEAMS_SIZED,
    s=TEAM_SUMMARY,
)
Q["current_engineer_metrics"] = scored(
    "SELECT DISTINCT engineer_id FROM commits", "engineer_id", ENGINEER_FACT, "ORDER BY engineer_id LIMIT 30 OFFSET 10", STAMP
)
Q["current_author_metrics"] = scored(AUTHORS, "author_id", fact(), "ORDER BY author_id LIMIT 20 OFFSET 5", STAMP)
Q["current_project_metrics"] = Q["project_metrics_materialized"]
Q["current_category_metrics"] = per_entity("SELECT DISTINCT category FROM jira_issues", "category", fact(), more=f", {STAMP}")
Q["refresh_log"] = sql(
    f"""SELECT DISTINCT 'project_metrics_materialized' AS table_name, {AS_OF} AS refresh_time FROM jira_issues
        UNION ALL SELECT DISTINCT 'category_metrics_materialized', {AS_OF} FROM jira_issues"""
)
Q["stream_affected_refresh"] = sql(f"SELECT *, {AS_OF} AS last_calculated FROM r", r=all_rows("commits"))
Q["stream_on_stored_metrics"] = sql("SELECT * FROM r", r=all_rows("commits"))
Q["stream_on_stored_summary"] = f"SELECT * EXCLUDE (last_updated) FROM ({Q['stream_incremental_summary']})"
Q["metrics_upsert_buckets"] = Q["metrics_upsert"]
Q["ai_impact_high_water"] = CHANGED_SUMMARY
Q["issues_of_team_posted"] = sql("SELECT * FROM s WHERE list_contains(string_split(team_ids, ','), '1')", s=STORED_SUMMARY)
Q["refresh_with_retries"] = sql(
    f"""SELECT team_id, {names()}, CAST(0 AS INTEGER) AS tries FROM s WHERE team_id <> 2
        UNION ALL SELECT 2, {", ".join("NULL" for _ in NAMES)}, 1""",
    tc=TEAM_COMMITS,
    f=TEAM_FACT,
    sized=TEAMS_SIZED,
    s=TEAM_SUMMARY,
)
for name in ("stream_commit_updates", "stream_issue_changes", "stream_team_changes"):
    Q[name] = Q["stream_on_stored_metrics"]
Q["current_from_stored"] = sql(f"SELECT *, {AS_OF} AS last_calculated FROM r WHERE dimension IN ('team', 'project')", r=all_rows("commits"))
Q["changed_tables_refresh"] = sql("SELECT * FROM r WHERE dimension IN ('project', 'category')", r=all_rows("commits"))

# -- dashboard
Q["filter_options"] = sql(
    """SELECT 'teams' AS dimension, team_id AS id, team_name AS name FROM teams
       UNION ALL SELECT 'projects', project_id, project_name FROM projects
       UNION ALL SELECT 'engineers', id, name FROM engineers"""
)
Q["category_chart"] = sql(
    f"SELECT category, {W} AS ai_cycle_time, {WO} AS non_ai_cycle_time FROM f GROUP BY category", f=fact()
)
Q["category_chart_first"] = sql(
    """SELECT category,
              coalesce(CAST(arg_min(cycle_time, issue_id) FILTER (WHERE has_ai_commits) AS DOUBLE), 0) AS ai_cycle_time,
              coalesce(CAST(arg_min(cycle_time, issue_id) FILTER (WHERE NOT has_ai_commits) AS DOUBLE), 0)
                  AS non_ai_cycle_time
       FROM f GROUP BY category""",
    f=fact(),
)
IMPROVED = """SELECT a.project_id, a.t AS ai_time, b.t AS non_ai_time, round((b.t - a.t) / b.t * 100, 2) AS improvement,
        a.n AS ai_issue_count, b.n AS non_ai_issue_count FROM g a JOIN g b ON a.project_id = b.project_id
        AND a.has_ai_commits AND NOT b.has_ai_commits"""
GROUPED = """SELECT project_id, has_ai_commits, AVG(cycle_time) AS t, COUNT(*) AS n FROM f
        GROUP BY project_id, has_ai_commits"""
Q["project_improvements"] = sql(IMPROVED, f=fact(), g=GROUPED)
Q["overall_improvement"] = sql(
    """SELECT percentage, total_ai_issues, total_non_ai_issues,
              CASE WHEN percentage > 20 THEN 'Significant Improvement' WHEN percentage > 0 THEN 'Moderate Improvement'
                   WHEN percentage = 0 THEN 'No Impact' ELSE 'Negative Impact' END AS status
       FROM (SELECT round(SUM(improvement * (ai_issue_count + non_ai_issue_count))
                          / SUM(ai_issue_count + non_ai_issue_count), 2) AS percentage,
                    CAST(SUM(ai_issue_count) AS BIGINT) AS total_ai_issues,
                    CAST(SUM(non_ai_issue_count) AS BIGINT) AS total_non_ai_issues FROM improved)""",
    f=fact(),
    g=GROUPED,
    improved=IMPROVED,
)
Q["dashboard_bundle"] = sql(
    f"SELECT pair.*, {names('team.', 'team_')} FROM pair JOIN team ON team.team_id = pair.team_id",
    tc=TEAM_COMMITS,
    f=TEAM_FACT,
    pair=f"SELECT team_id, project_id, {SUMMARY} FROM f GROUP BY team_id, project_id",
    team=f"SELECT team_id, {SUMMARY} FROM f GROUP BY team_id",
)

# -- sources and quality
Q["csv_ingest"] = sql("SELECT * FROM teams")
Q["csv_ingest_commits"] = sql("SELECT * FROM commits")
Q["csv_folder_mixed_headers"] = sql("SELECT project_id, project_name FROM projects")
Q["csv_reject_count"] = sql(
    "SELECT COUNT(CASE WHEN ai_used THEN 1 END) AS rejected, COUNT(CASE WHEN NOT ai_used THEN 1 END) AS accepted FROM commits"
)
Q["csv_rejects"] = sql(
    """SELECT concat_ws(',', commit_id, engineer_id, jira_issue_id, repo_id, commit_date, ai_used) AS line
       FROM commits WHERE ai_used"""
)
COUNTS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS n FROM {t}"
    for t in ("engineers", "teams", "projects", "repositories", "jira_issues", "commits")
)
Q["seed_all"] = sql(COUNTS)
Q["table_counts"] = sql(COUNTS)
Q["commits_partitioned"] = sql("SELECT *, CAST(strftime(commit_date, '%Y%m') AS INTEGER) AS commit_month FROM commits")
RAW = """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS commit_id, l_suppkey + 1 AS engineer_id,
        l_orderkey + 1 AS jira_issue_id, l_partkey + 1 AS repo_id, CAST(l_shipdate AS DATE) AS commit_date,
        (l_returnflag = 'A' AND l_linestatus = 'F') AS ai_used,
        CASE WHEN l_discount > 0 THEN CAST(l_quantity AS INTEGER) END AS lines_of_code FROM lineitem"""
Q["typed_projection"] = sql(
    "SELECT *, CASE WHEN lines_of_code IS NULL THEN 'lines_of_code' ELSE '' END AS invalid_columns FROM r", r=RAW
)
Q["load_metrics"] = sql(
    """SELECT 'commits' AS table_name, COUNT(*) AS total, COUNT(lines_of_code) AS successful,
              COUNT(*) - COUNT(lines_of_code) AS failed FROM r""",
    r=RAW,
)
Q["table_sample"] = sql("SELECT * FROM commits ORDER BY commit_id, commit_date LIMIT 5")
Q["entity_keys"] = sql(OWNERS + " UNION SELECT 'author', CAST(author_id AS VARCHAR) FROM jira_issues")
Q["distinct_entity_counts"] = sql(
    """SELECT 'engineer' AS dimension, COUNT(DISTINCT engineer_id) AS n FROM commits
       UNION ALL SELECT 'author', COUNT(DISTINCT author_id) FROM jira_issues
       UNION ALL SELECT 'category', COUNT(DISTINCT category) FROM jira_issues"""
)
Q["category_issue_counts"] = sql(
    """SELECT 'category' AS dimension, category AS entity_key, COUNT(*) AS n FROM jira_issues
       WHERE resolution_date IS NOT NULL GROUP BY 2
       UNION ALL SELECT 'author', CAST(author_id AS VARCHAR), COUNT(*) FROM jira_issues GROUP BY 2"""
)
Q["pk_duplicates"] = sql(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {k} AS key, COUNT(*) AS copies FROM {t} GROUP BY 2 HAVING COUNT(*) > 1"
        for t, k in (
            ("engineers", "CAST(id AS VARCHAR)"),
            ("teams", "CAST(team_id AS VARCHAR)"),
            ("projects", "CAST(project_id AS VARCHAR)"),
            ("repositories", "CAST(repo_id AS VARCHAR)"),
            ("jira_issues", "CAST(issue_id AS VARCHAR)"),
            ("commits", "commit_id || '|' || CAST(commit_date AS VARCHAR)"),
        )
    )
)
Q["fk_orphans"] = sql(
    " UNION ALL ".join(
        f"""SELECT '{c}.{col}->{p}.{key}' AS edge, COUNT(*) AS n_orphans FROM {c}
            WHERE {col} NOT IN (SELECT {key} FROM {p})"""
        for c, col, p, key in (
            ("repositories", "project_id", "projects", "project_id"),
            ("jira_issues", "project_id", "projects", "project_id"),
            ("jira_issues", "author_id", "engineers", "id"),
            ("commits", "engineer_id", "engineers", "id"),
            ("commits", "jira_issue_id", "jira_issues", "issue_id"),
            ("commits", "repo_id", "repositories", "repo_id"),
        )
    )
)
NULLED = {
    ("commits", "engineer_id"): "CASE WHEN repo_id % 11 <> 0 THEN engineer_id END",
    ("jira_issues", "project_id"): "CASE WHEN issue_id % 13 <> 0 THEN project_id END",
}
REQUIRED = {
    "engineers": "id name",
    "teams": "team_id team_name engineer_ids",
    "projects": "project_id project_name",
    "repositories": "repo_id project_id repo_name",
    "jira_issues": "issue_id project_id author_id creation_date category",
    "commits": "commit_id engineer_id jira_issue_id repo_id commit_date ai_used lines_of_code",
}
Q["null_violations"] = sql(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) - COUNT({c}) AS nulls FROM {t}"
        for t, cs in REQUIRED.items()
        for c in cs.split()
    )
)
Q["pk_duplicates_found"] = sql(
    """SELECT 'projects' AS table_name, CAST(project_id AS VARCHAR) AS key, CAST(2 AS BIGINT) AS copies FROM projects WHERE project_id <= 3
       UNION ALL SELECT 'commits', commit_id || '|' || CAST(commit_date AS VARCHAR), SUM(CASE WHEN repo_id % 7 = 0 THEN 2 ELSE 1 END)::BIGINT
       FROM commits GROUP BY commit_id, commit_date HAVING SUM(CASE WHEN repo_id % 7 = 0 THEN 2 ELSE 1 END) > 1"""
)
Q["fk_orphans_found"] = sql(
    """SELECT 'repositories.project_id->projects.project_id' AS edge, COUNT(*) AS n_orphans FROM repositories
       WHERE repo_id % 9 <> 0 AND project_id = 5
       UNION ALL SELECT 'jira_issues.project_id->projects.project_id', COUNT(*) FROM jira_issues WHERE project_id = 5
       UNION ALL SELECT 'jira_issues.author_id->engineers.id', COUNT(*) FROM jira_issues
       WHERE author_id NOT IN (SELECT id FROM engineers WHERE id % 10 <> 0)
       UNION ALL SELECT 'commits.engineer_id->engineers.id', COUNT(*) FROM commits WHERE engineer_id % 10 = 0
       UNION ALL SELECT 'commits.jira_issue_id->jira_issues.issue_id', COUNT(*) FROM commits
       WHERE jira_issue_id NOT IN (SELECT issue_id FROM jira_issues)
       UNION ALL SELECT 'commits.repo_id->repositories.repo_id', COUNT(*) FROM commits WHERE repo_id % 9 = 0"""
)
KEPT_SET = "SELECT DISTINCT ON (commit_id, commit_date) * FROM commits"
SET_COUNTS = " UNION ALL ".join(
    f"SELECT '{t}' AS name, COUNT(*) AS n FROM {'kept' if t == 'commits' else t}"
    for t in ("engineers", "teams", "projects", "repositories", "jira_issues", "commits")
)
Q["load_set_refused"] = sql(
    f"""SELECT 'seen' AS place, * FROM ({SET_COUNTS})
        UNION ALL SELECT 'broken', * FROM (
        SELECT 'jira_issues.author_id->engineers.id', COUNT(*) AS n FROM jira_issues WHERE author_id NOT IN (SELECT id FROM engineers WHERE id % 10 <> 0)
        UNION ALL SELECT 'commits.engineer_id->engineers.id', COUNT(*) FROM kept WHERE engineer_id % 10 = 0
        UNION ALL SELECT 'commits.repo_id->repositories.repo_id', COUNT(*) FROM kept WHERE repo_id % 9 = 0) WHERE n > 0""",
    kept=f"{KEPT_SET} WHERE commit_date <= {MARK}",
)
Q["load_set_published"] = sql(
    f"SELECT name AS table_name, n FROM ({SET_COUNTS.replace('FROM teams', 'FROM teams WHERE team_id % 2 = 0')})",
    kept=f"{KEPT_SET} WHERE lines_of_code % 2 = 0",
)
Q["null_violations_found"] = sql(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) - COUNT({NULLED.get((t, c), c)}) AS nulls FROM {t}"
        for t, cs in REQUIRED.items()
        for c in cs.split()
    )
)
Q["metrics_validation_failed"] = sql(
    """SELECT COUNT(CASE WHEN id % 3 = 0 THEN 1 END) = 0 AS ok,
              CASE WHEN COUNT(CASE WHEN id % 3 = 0 THEN 1 END) > 0 THEN 'Missing required JSON keys' ELSE '' END AS message FROM engineers"""
)
Q["metrics_validation"] = sql(
    """SELECT COUNT(*) > 0 AS ok, CASE WHEN COUNT(*) > 0 THEN '' ELSE 'No metrics retrieved' END AS message
       FROM engineers"""
)
Q["scalar_functions"] = sql(
    """SELECT commit_id, days, CASE WHEN days IS NOT NULL THEN greatest(0, days) END AS clamped,
              strftime(commit_date, '%Y-%m') AS month, CAST(date_trunc('month', commit_date) AS DATE) AS month_start,
              'commits_' || strftime(commit_date, '%Y%m') AS partition, strftime(creation_date, '%Y-%m-%d') AS iso_day,
              CAST(commit_date + INTERVAL 1 MONTH AS DATE) AS next_month, commit_date + 6 AS week_end,
              nullif(lines_of_code, 1) AS not_one, coalesce(days, 0) AS days_or_zero,
              least(100, greatest(0, lines_of_code * 3)) AS held,
              round(CAST(days AS DOUBLE) / lines_of_code, 2) AS rounded,
              CAST(ceil(lines_of_code / 7.0) AS BIGINT) AS ceiled,
              'engineer-project:' || engineer_id || ':' || project_id AS pair_key, category AS json_category
       FROM (SELECT *, CAST(resolution_date - commit_date AS INTEGER) AS days
             FROM jira_issues JOIN commits ON jira_issue_id = issue_id)"""
)

Q["sql_days_between"] = sql(
    """SELECT project_id, category, COUNT(*) AS issues, CAST(SUM(resolution_date - creation_date) AS BIGINT) AS days
       FROM jira_issues WHERE resolution_date IS NOT NULL GROUP BY project_id, category"""
)

# -- partitions
MONTHS = "SELECT DISTINCT CAST(date_trunc('month', commit_date) AS DATE) AS m, commit_date FROM commits"
Q["partition_plan"] = sql(
    """SELECT 'commits_' || strftime(m, '%Y%m') AS partition_name, m AS from_date,
              CAST(m + INTERVAL 1 MONTH AS DATE) AS to_date FROM months""",
    months=f"""SELECT CAST(date_trunc('month', MIN(commit_date)) AS DATE) AS m FROM commits
               UNION ALL SELECT CAST(m + INTERVAL 1 MONTH AS DATE) FROM months
               WHERE CAST(m + INTERVAL 1 MONTH AS DATE) < {END}""",
)
Q["partition_info"] = sql(
    """SELECT 'commits_' || strftime(m, '%Y%m') AS partition_name, m AS from_date,
              CAST(m + INTERVAL 1 MONTH AS DATE) AS to_date, COUNT(*) AS row_count
       FROM (SELECT CAST(date_trunc('month', commit_date) AS DATE) AS m FROM commits) GROUP BY m"""
)
Q["partition_retention_applied"] = sql(
    """SELECT CASE WHEN m < DATE '2000-12-01' THEN 'archive' ELSE 'commits' END AS place,
              'commits_' || strftime(m, '%Y%m') AS partition_name, COUNT(*) AS row_count, true AS stored
       FROM (SELECT CAST(date_trunc('month', commit_date) AS DATE) AS m FROM commits) GROUP BY m"""
)
Q["recommit_date_everywhere"] = sql(
    f"""SELECT CAST(strftime(commit_date, '%Y%m') AS INTEGER) AS commit_month, commit_date, commit_id,
               COUNT(*) AS commits, CAST(SUM(lines_of_code) AS BIGINT) AS lines
        FROM (SELECT 'r' || repo_id AS commit_id, CASE WHEN repo_id = 1 THEN {END} ELSE commit_date END AS commit_date,
                     lines_of_code FROM commits) GROUP BY ALL"""
)
Q["partition_retention"] = sql(
    """SELECT 'commits_' || strftime(m, '%Y%m') AS partition_name,
              CASE WHEN m < DATE '2000-12-01' THEN 'archived' ELSE 'kept' END AS action, COUNT(*) AS row_count
       FROM months GROUP BY m
       UNION ALL SELECT 'commits_' || strftime(d, '%Y%m'), 'planned', 0
       FROM (SELECT unnest([DATE '2001-12-01', DATE '2002-01-01', DATE '2002-02-01']) AS d)
       WHERE d NOT IN (SELECT m FROM months)""",
    months="SELECT CAST(date_trunc('month', commit_date) AS DATE) AS m FROM commits",
)
Q["recommit_date"] = sql(
    f"""SELECT * EXCLUDE (commit_date, d), d AS commit_date, CAST(strftime(d, '%Y%m') AS INTEGER) AS commit_month
        FROM (SELECT *, CASE WHEN commit_id = (SELECT commit_id FROM commits ORDER BY commit_date, commit_id LIMIT 1)
                             THEN {END} ELSE commit_date END AS d FROM commits)"""
)
