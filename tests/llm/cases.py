"""Awkward documents that every operator on texts must take."""

from __future__ import annotations

import random

LETTERS = "aeinorstldcu"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 8))) for _ in range(n))


def documents(spark, rows=None):
    """doc_id, text and columns whose names the operators use themselves; rows are (doc_id, text)."""
    rows = awkward() if rows is None else rows
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id long, rules string, rank int"
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), None, -1, "x", 0) for i, t in rows], schema)


def awkward() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    long = words(rng, 30_000)
    base = words(rng, 80)
    near = base.split()
    near[40] = "changed"
    return [
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (4, base),
        (5, base.replace(" ", " \n", 1)),
        (5, base.replace(" ", " \n", 1)),  # a repeated row
        (6, " ".join(near)),
        (7, long),
        (8, long + " end"),
        (9, "One two"),
        (10, "one TWO"),
        (11, "x" * 50_000),
        (None, base),
        (None, None),
        (12, "éà 漢字 😀 \u0000 ***"),
    ]
