"""Authors, years, dates, versions, and quality classes of records as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.keys import as_column, iso_instant

DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "dd/MM/yyyy", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "yyyyMMdd")


def surname(author: str | Column) -> Column:
    """The first author's surname in lower case: "et al" and further authors left out, "Name, First" turned."""
    first = F.split(F.regexp_replace(as_column(author), r"(?i)\s+et\s+al\.?.*$", ""), r"\s+and\s+|\s*[&;/]\s*").getItem(0)
    name = F.when(first.contains(","), F.split(first, ",").getItem(0)).otherwise(F.element_at(F.split(F.btrim(first), r"\s+"), -1))
    return F.nullif(F.lower(F.btrim(name)), F.lit(""))


def year(text: str | Column) -> Column:
    """The first year from 1900 to 2099 in a text; null without one."""
    return F.nullif(F.regexp_extract(as_column(text), r"((?:19|20)\d\d)", 1), F.lit(""))


def any_date(text: str | Column) -> Column:
    """A date in ISO or one of the common written forms as TIMESTAMP; null where none fits."""
    t = F.btrim(as_column(text))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS], iso_instant(t))


def pdf_class(coverage: Column, scanned: Column, tables: Column, columns: Column, images: Column) -> Column:
    """scanned, complex, digital or mixed, and so which reader suits: by text coverage, probability of a scan, tables, columns, share of images."""
    return F.when((scanned >= 0.7) | (coverage < 0.1), "scanned").when(tables | columns | (images > 0.5), "complex").when(coverage >= 0.8, "digital").otherwise("mixed")


def column_count(gaps: Column, width: Column) -> Column:
    """1 to 3 columns of a page: gaps between sorted block centres over 0.3 x width begin a new one."""
    return F.least(F.lit(3), 1 + F.size(F.filter(gaps, lambda g: g > 0.3 * width)))


def error_category(message: str | Column) -> Column:
    """The kind of a failure from its message."""
    m = F.lower(F.coalesce(as_column(message), F.lit("")))
    kinds = {"permission": "permission|access denied", "missing": "no such file|not found", "encrypted": "encrypt|password", "malformed": "malformed|corrupt|parse|decode", "timeout": "timed? ?out", "memory": "memory", "dependency": "no module|import"}
    out = F.lit("unknown")
    for kind, pattern in reversed(kinds.items()):
        out = F.when(m.rlike(pattern), kind).otherwise(out)
    return out


def identifier_problem(x: str | Column, most: int = 64) -> Column:
    """Why a text is no identifier: empty, too_long or characters; null if it is one."""
    c = as_column(x)
    return F.when(F.coalesce(c, F.lit("")) == "", "empty").when(F.length(c) > most, "too_long").when(~c.rlike("^[A-Za-z0-9][A-Za-z0-9._:/-]*$"), "characters")
