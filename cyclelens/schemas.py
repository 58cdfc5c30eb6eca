"""Fixed schemas, keys and references of the six base tables.

Ids are 64-bit: at the target scale there are more issues and commits than a 32-bit id can number.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_LONG, _INT, _STR, _DATE, _BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.DateType(), T.BooleanType()

# Load order follows the references: a table comes after the tables it points to.
SCHEMAS: dict[str, T.StructType] = {
    "engineers": _struct(("id", _LONG, False), ("name", _STR, False)),
    "teams": _struct(("team_id", _LONG, False), ("team_name", _STR, False), ("engineer_ids", _STR, False)),
    "projects": _struct(("project_id", _LONG, False), ("project_name", _STR, False)),
    "repositories": _struct(("repo_id", _LONG, False), ("project_id", _LONG, False), ("repo_name", _STR, False)),
    "jira_issues": _struct(
        ("issue_id", _LONG, False),
        ("project_id", _LONG, False),
        ("author_id", _LONG, False),
        ("creation_date", _DATE, False),
        ("resolution_date", _DATE, True),
        ("category", _STR, False),
    ),
    "commits": _struct(
        ("commit_id", _STR, False),
        ("engineer_id", _LONG, False),
        ("jira_issue_id", _LONG, False),
        ("repo_id", _LONG, False),
        ("commit_date", _DATE, False),
        ("ai_used", _BOOL, False),
        ("lines_of_code", _INT, False),
    ),
}

TABLES = tuple(SCHEMAS)

PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "engineers": ("id",),
    "teams": ("team_id",),
    "projects": ("project_id",),
    "repositories": ("repo_id",),
    "jira_issues": ("issue_id",),
    "commits": ("commit_id", "commit_date"),
}

# (child table, child column, parent table, parent column)
REFERENCES: tuple[tuple[str, str, str, str], ...] = (
    ("repositories", "project_id", "projects", "project_id"),
    ("jira_issues", "project_id", "projects", "project_id"),
    ("jira_issues", "author_id", "engineers", "id"),
    ("commits", "engineer_id", "engineers", "id"),
    ("commits", "jira_issue_id", "jira_issues", "issue_id"),
    ("commits", "repo_id", "repositories", "repo_id"),
)


def columns(table: str) -> list[str]:
    return SCHEMAS[table].fieldNames()


def required_columns(table: str) -> list[str]:
    return [f.name for f in SCHEMAS[table].fields if not f.nullable]
