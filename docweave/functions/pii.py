"""Personal data in texts: spans by pattern and allow-list, masks, reports.

Patterns are written so that Java's and RE2's dialects read them alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<entity_type:string,value:string,start:int,stop:int,confidence:double>"
# What counts as which kind of personal data.
PATTERNS = {
    "EMAIL_ADDRESS": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}\b",
    "PHONE_NUMBER": r"(?:\+44|0)\s?(?:[0-9]\s?){9,10}|\([0-9]{3}\)\s?[0-9]{3}[-.\s]?[0-9]{4}|\+[0-9]{1,3}[-.\s]?[0-9]{6,14}",
    "CREDIT_CARD": r"\b(?:4[0-9]{3}|5[1-5][0-9]{2}|6011|3[47][0-9]{2})[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}\b",
    "US_SSN": r"\b[0-9]{3}[-\s]?[0-9]{2}[-\s]?[0-9]{4}\b",
    "UK_NINO": r"\b[A-CEGHJ-PR-TW-Za-ceghj-pr-tw-z]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[A-Da-d]\b",
    "IBAN_CODE": r"\b[A-Z]{2}[0-9]{2}\s?(?:[A-Z0-9]\s?){11,30}\b",
    "IP_ADDRESS": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b|\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b",
    "URL": r"\bhttps?://[^\s<>\"{}|\\^`\[\]]+\b",
    "DATE": r"\b[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}\b|\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
}
ALLOWED = r"\(555\)\s?[0-9]{3}|555[-.\s][0-9]{3}|@example\.(?:com|org|net)$"
CONFIDENCE, SURE = 0.9, 0.85


def matches(text: str | Column, kind: str) -> Column:
    """The array of a kind's matches that the allow-list does not take out; empty for null."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(PATTERNS[kind]), F.lit(0)), lambda m: ~m.rlike(ALLOWED))


def counts(text: str | Column, kinds: list[str] | None = None) -> list[Column]:
    """One column a kind, named n_<kind in lower case>: how many matches a text has."""
    return [F.size(matches(text, k)).alias(f"n_{k.lower()}") for k in kinds or PATTERNS]


def spans_of(text: str | None, kinds: list[str] | None = None, confidence: float = CONFIDENCE, extra: Callable[[str], list[tuple[str, int, int, float]]] | None = None) -> list[dict]:
    """Spans by start, of those that overlap the first, and of those that start together the surest, then the longest.

    extra is another engine: with it the patterns are not used, as it is there to replace them.
    """
    if not text:
        return []
    if extra is not None:
        found = [(a, -c, -b, kind) for kind, a, b, c in extra(text)]
    else:
        found = [(m.start(), -confidence, -m.end(), kind) for kind in kinds or PATTERNS for m in re.finditer(PATTERNS[kind], text) if not re.search(ALLOWED, m[0])]
    out, end = [], 0
    for a, c, b, kind in sorted(found):
        if a >= end:
            out.append({"entity_type": kind, "value": text[a:-b], "start": a, "stop": -b, "confidence": -c})
            end = -b
    return out


def detect(text: str | Column, kinds: list[str] | None = None, engine: Callable[[str], list[tuple[str, int, int, float]]] | None = None) -> Column:
    """spans_of() as a column; an empty array for null."""

    @F.pandas_udf(f"array<{SPAN}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([spans_of(t, kinds, extra=engine) for t in s], dtype="object")

    return run(F.col(text) if isinstance(text, str) else text)


def masked(text: str | Column, kinds: list[str] | None = None, sign: str = "█") -> Column:
    """Every span covered by as many signs as it has characters; null for null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for t in s:
                for x in reversed(spans_of(t, kinds)):
                    t = t[: x["start"]] + sign * (x["stop"] - x["start"]) + t[x["stop"] :]
                out.append(t)
            yield pd.Series(out, dtype="object")

    return run(F.col(text) if isinstance(text, str) else text)


def report(found: DataFrame, spans: str = "spans") -> DataFrame:
    """One row: total, by_type (a map), sure and unsure counts at 0.85, and the three most frequent types, ties by name."""
    each = found.select(F.explode(spans).alias("s")).select("s.entity_type", "s.confidence")
    kinds = each.groupBy("entity_type").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= SURE).alias("sure"))
    whole = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("by_type"), F.coalesce(F.sum("sure"), F.lit(0)).alias("sure"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "entity_type"))).alias("__t"))  # a row a type
    return whole.select("total", "by_type", "sure", (F.col("total") - F.col("sure")).alias("unsure"), F.transform(F.slice("__t", 1, 3), lambda x: x["entity_type"]).alias("top_types"))
