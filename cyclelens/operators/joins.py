"""Joins whose strategy follows the counted size of the lookup side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lookup sides are two or three narrow columns; this many rows stay far below 100 MB once hashed.
BROADCAST_ROWS = 500_000


def within_rows(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `rows` rows. A plain count: every task sends one number, however large the table is."""
    return df.count() <= rows


def lookup_join(facts: DataFrame, lookup: DataFrame, key: str, how: str = "inner", small: bool | None = None) -> DataFrame:
    """facts joined with a lookup table on `key`.

    A lookup counted as small goes to every executor and the facts stay where they are. Otherwise both sides are shuffled
    on the key without a hint, and no row is repeated beforehand: adaptive execution splits a partition that a hot key
    makes large, and repeats only the lookup rows of that partition.
    """
    if within_rows(lookup) if small is None else small:
        return facts.join(F.broadcast(lookup), key, how)
    return facts.join(lookup, key, how)
