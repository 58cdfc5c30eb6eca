"""Top-k within groups and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(counted: DataFrame, group: str, by: str, tie: str, k: int = 5) -> DataFrame:
    """The k largest rows of each group, ties broken by `tie`, with their rank.

    `counted` is already aggregated. Spark keeps k rows per group and task before the shuffle (WindowGroupLimit),
    so a group with very many members costs no single task more than k rows per sending task.
    """
    order = Window.partitionBy(group).orderBy(F.desc(by), F.asc(tie))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nest_ranked(ranked: DataFrame, group: str, name: str, entry: Column) -> DataFrame:
    """The ranked rows of each group as one ordered array; its length is bounded by the k of the ranking."""
    nested = ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))).alias("_r"))
    return nested.select(group, F.transform("_r", lambda r: r["entry"]).alias(name))


def page(df: DataFrame, key: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows ordered by key, skipping `offset` and keeping `limit` of them (all, if not given)."""
    ordered = df.orderBy(key)
    if offset:
        ordered = ordered.offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def page_after(df: DataFrame, key: str, after: object = None, limit: int = 100) -> DataFrame:
    """The next `limit` rows by a unique key, behind the last key of the page before: no task holds more than `limit` rows,
    however deep the page lies."""
    rest = df if after is None else df.where(F.col(key) > F.lit(after))
    return rest.orderBy(key).limit(limit)
