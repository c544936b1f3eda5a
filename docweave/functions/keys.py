"""Forms of keys, names and dates as they compare in this project's tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def as_column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm_key(x: str | Column) -> Column:
    """A key for comparison: outer white space removed, lower case; blank becomes null."""
    trimmed = F.lower(F.btrim(as_column(x), F.lit(BLANKS)))
    return F.when(trimmed != "", trimmed)


def iso_instant(x: str | Column) -> Column:
    """An ISO 8601 text as TIMESTAMP; without an offset it is UTC; null where it is no date."""
    text = F.btrim(as_column(x), F.lit(BLANKS))
    zoned = F.when(text.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$") & text.rlike(r"\d:\d"), text).otherwise(F.concat(text, F.lit("Z")))
    return zoned.try_cast("timestamp")


def month(x: str | Column) -> Column:
    """yyyy-MM of a time stamp."""
    return F.date_format(as_column(x), "yyyy-MM")
