"""The engine's vocabulary for `spark.sql`: base tables as views and the one SQL function they are queried with."""

from __future__ import annotations

from cyclelens import schemas
from cyclelens.domain import Domain


def register(domain: Domain) -> None:
    """Makes the base tables and `days_between(start, end)` known to the session's SQL.

    The function is a SQL expression, which Spark inlines into the plan.
    """
    domain.spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION days_between(first_day DATE, last_day DATE) RETURNS INT "
        "RETURN datediff(last_day, first_day)"
    )
    for table in schemas.TABLES:
        domain.table(table).createOrReplaceTempView(table)
    domain.members.createOrReplaceTempView("team_members")
