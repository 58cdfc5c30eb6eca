"""Scalar expressions: dates, parsing, ratios and scores. All run inside whole-stage codegen."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def days_between(start: ColumnLike, end: ColumnLike) -> Column:
    """Whole days from start to end; negative when end comes first."""
    return F.datediff(_c(end), _c(start))


def clamped_days(start: ColumnLike, end: ColumnLike) -> Column:
    """Whole days from start to end, never below zero."""
    days = days_between(start, end)
    return F.when(days.isNotNull(), F.greatest(F.lit(0), days))


def month_start(day: ColumnLike) -> Column:
    return F.trunc(_c(day), "MM")


def month_text(day: ColumnLike) -> Column:
    return F.date_format(_c(day), "yyyy-MM")


def iso_day(day: ColumnLike) -> Column:
    return F.date_format(_c(day), "yyyy-MM-dd")


def partition_name(day: ColumnLike) -> Column:
    return F.concat(F.lit("commits_"), F.date_format(_c(day), "yyyyMM"))


def instant(moment: datetime | date) -> Column:
    """A zone-free timestamp literal, so results do not depend on the session time zone."""
    if not isinstance(moment, datetime):
        moment = datetime(moment.year, moment.month, moment.day)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def packed(text: ColumnLike) -> Column:
    """A text in fewer bytes for a shuffle: two digits or dashes a byte, as two hex digits of a hash; any other text as it is, behind a mark."""
    text = F.col(text) if isinstance(text, str) else text
    even = F.length(text) % 2 == 0
    numbers = F.unhex(F.concat(F.when(even, "FF").otherwise("F"), F.translate(text, "-", "A")))
    hashed = F.concat(F.unhex(F.lit("01")), F.unhex(text))
    plain = F.concat(F.unhex(F.lit("00")), text.cast("binary"))
    return F.when(text.rlike(r"\A[0-9-]+\z"), numbers).when(text.rlike(r"\A[0-9a-f]+\z") & even, hashed).otherwise(plain)


def unpacked(code: ColumnLike) -> Column:
    """The text of `packed`."""
    code = F.col(code) if isinstance(code, str) else code
    digits, rest = F.hex(code), 2**31 - 1
    numbers = F.translate(F.regexp_replace(digits, "^F+", ""), "A", "-")
    return F.when(digits.startswith("F"), numbers).when(digits.startswith("01"), F.lower(F.substring(digits, 3, rest))).otherwise(F.substring(code, 2, rest).cast("string"))


def id_list(text: ColumnLike) -> Column:
    """Ids named in a comma-separated text, blanks around them ignored."""
    return F.transform(F.split(_c(text), ","), lambda part: F.trim(part).try_cast("bigint"))


def blank_to_null(text: ColumnLike) -> Column:
    return F.nullif(F.trim(_c(text)), F.lit(""))


def leading_int(text: ColumnLike, kind: str = "bigint") -> Column:
    """The integer a text starts with; NULL when it starts with none ('12abc' is 12, 'abc' is NULL)."""
    return F.regexp_extract(_c(text), r"^\s*([+-]?\d+)", 1).try_cast(kind)


def true_flag(text: ColumnLike) -> Column:
    """True only for the word 'true' in any case; a missing value is false."""
    return F.coalesce(F.lower(_c(text)) == "true", F.lit(False))


def share(part: ColumnLike, whole: ColumnLike) -> Column:
    """part / whole as a fraction, 0 when there is no whole."""
    return F.coalesce(F.try_divide(_c(part).cast("double"), _c(whole).cast("double")), F.lit(0.0))


def percent(part: ColumnLike, whole: ColumnLike) -> Column:
    return share(part, whole) * 100


def impact_percent(with_ai: ColumnLike, without_ai: ColumnLike) -> Column:
    """How much shorter the AI side is, in percent of the other side; 0 unless the other side is positive."""
    w, wo = _c(with_ai), _c(without_ai)
    return F.when(wo > 0, F.try_divide(wo - w, wo) * 100).otherwise(F.lit(0.0))


def efficiency_score(impact: ColumnLike, commits_with: ColumnLike, commits_without: ColumnLike) -> Column:
    """impact * 0.7 + commit ratio * 30, held between 0 and 100; the ratio is 1 without commits to compare with."""
    w, wo = _c(commits_with), _c(commits_without)
    ratio = F.when(wo > 0, F.try_divide(w, wo)).otherwise(F.lit(1.0))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), _c(impact) * 0.7 + ratio * 30))


def to_fixed(value: ColumnLike, digits: int = 2) -> Column:
    """value rounded half away from zero on its binary value, as the dashboard prints it (0.575 gives 0.57)."""
    v, scale = _c(value), float(10**digits)
    return F.signum(v) * F.floor(F.abs(v) * scale + 0.5) / scale


def improvement_label(percentage: ColumnLike) -> Column:
    p = _c(percentage)
    return (
        F.when(p > 20, "Significant Improvement")
        .when(p > 0, "Moderate Improvement")
        .when(p == 0, "No Impact")
        .otherwise("Negative Impact")
    )
