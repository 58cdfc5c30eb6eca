from __future__ import annotations

import os
import sys
from datetime import date

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cyclelens import schemas  # noqa: E402
from cyclelens.domain import Domain  # noqa: E402
from cyclelens.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def star(spark):
    return Domain.from_star(spark, SF)


D = date

# Hand-written tables: team 3 has no commits, engineer 4 is in no team and engineer 1 in two, issue 13 has no commits,
# issue 14 is unresolved, issue 12 is resolved before its commit, project 3 has no issues.
ROWS = {
    "engineers": [(1, "Ada"), (2, "Bo"), (3, "Cy"), (4, "Di"), (5, "Ed")],
    "teams": [(1, "Core", "1, 2"), (2, "Edge", "3,1"), (3, "Idle", "5")],
    "projects": [(1, "P1"), (2, "P2"), (3, "P3")],
    "repositories": [(1, 1, "r1"), (2, 2, "r2")],
    "jira_issues": [
        (10, 1, 1, D(2024, 1, 1), D(2024, 1, 21), "bug"),
        (11, 1, 2, D(2024, 1, 2), D(2024, 1, 12), "bug"),
        (12, 2, 1, D(2024, 1, 3), D(2024, 1, 5), "chore"),
        (13, 2, 3, D(2024, 1, 4), D(2024, 1, 9), "docs"),
        (14, 2, 3, D(2024, 1, 5), None, "feature"),
        (15, 1, 1, D(2024, 2, 1), D(2024, 2, 20), "chore"),
    ],
    "commits": [
        ("a", 1, 10, 1, D(2024, 1, 1), True, 10),
        ("b", 2, 10, 1, D(2024, 1, 6), False, 20),
        ("c", 2, 11, 1, D(2024, 1, 2), False, 5),
        ("d", 3, 12, 2, D(2024, 1, 8), False, 1),
        ("e", 4, 14, 2, D(2024, 1, 9), True, 2),
        ("f", 4, 15, 2, D(2024, 2, 10), False, 3),
        ("g", 1, 15, 2, D(2024, 2, 12), True, 4),
    ],
}


def make_domain(spark, rows=ROWS) -> Domain:
    return Domain.from_tables({t: spark.createDataFrame(rows[t], schemas.SCHEMAS[t]) for t in schemas.TABLES})


@pytest.fixture(scope="session")
def small(spark):
    return make_domain(spark)


@pytest.fixture(scope="session")
def empty(spark):
    return make_domain(spark, {t: [] for t in schemas.TABLES})


def rows_by(df, key):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}


def as_set(df):
    columns = sorted(df.columns)
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())
