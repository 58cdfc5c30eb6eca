"""Reporting periods and their assignment to dates."""

from __future__ import annotations

import calendar
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Interval name -> (months, days) added per step. Fixed values.
STEPS = {"day": (0, 1), "week": (0, 7), "month": (1, 0), "quarter": (3, 0)}


def _step(day: date, months: int, days: int) -> date:
    if not months:
        return day + timedelta(days=days)
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    return date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


def period_list(start: date, end: date, interval: str = "month") -> list[tuple[date, date]]:
    """Periods (first day, last day) from start until one begins after end.

    Each period starts one interval after the previous one began, so a start on the 31st drifts to shorter month ends
    and stays there; the last period may run past `end`.
    """
    if interval not in STEPS:
        raise ValueError(f"Unsupported interval: {interval}")
    months, days = STEPS[interval]
    periods, current = [], start
    while current <= end:
        following = _step(current, months, days)
        periods.append((current, following - timedelta(days=1)))
        current = following
    return periods


def period_table(spark: SparkSession, start: date, end: date, interval: str = "month") -> DataFrame:
    """(period_start, period_end), one row per period."""
    return spark.createDataFrame(period_list(start, end, interval), "period_start date, period_end date")


def period_calendar(spark: SparkSession, start: date, end: date, interval: str = "month") -> DataFrame:
    """(day, period_start): every day of every period.

    Periods do not overlap, so the range condition "date within period" becomes an equality on the day, and the join
    a hash join instead of comparing every row with every period.
    """
    table = period_table(spark, start, end, interval)
    return table.select(F.explode(F.sequence("period_start", "period_end")).alias("day"), "period_start")


def in_period(df: DataFrame, day_column: str, days: DataFrame) -> DataFrame:
    """df with the period its date falls in; rows outside all periods are left out.

    A calendar has one row per day, and the date type ends with the year 9999: 3.7 million narrow rows at most.
    """
    return df.join(F.broadcast(days.withColumnRenamed("day", day_column)), day_column)


def first_day(commits: DataFrame) -> date | None:
    """The date of the first commit; of commits stored by month, only the first month's folder is read for it."""
    if "commit_month" in commits.columns:
        month = commits.agg(F.min("commit_month")).first()[0]
        commits = commits.where(F.col("commit_month") == F.lit(month))
    return commits.agg(F.min("commit_date")).first()[0]
