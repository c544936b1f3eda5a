"""A question into sub-queries by rules, and results of sub-queries into one list; budgets and references of a conversation."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_PARTS = 5
_VERSUS = re.compile(r"(?:compare\s+|difference between\s+)?(.+?)\s+(?:vs\.?|versus|compared (?:to|with))\s+(.+?)(?:\s+(?:for|in terms of)\s+(.+?))?\??$", re.I)
_BETWEEN = re.compile(r"(?:what is the |what are the )?differences? between\s+(.+?)\s+and\s+(.+?)(?:\s+(?:for|in terms of)\s+(.+?))?\??$", re.I)
_ASPECTS = re.compile(r"(?:what are the\s+)?(.+?)\s+(?:of|and its|and their)\s+(.+?)\??$", re.I)
_ASPECT_WORDS = re.compile(r"\b(advantages?|benefits?|disadvantages?|costs?|risks?|limits?|performance|features?|pros|cons)\b", re.I)
_AND = re.compile(r"\s+(?:and also|as well as|and|also)\s+", re.I)


@dataclass(frozen=True)
class SubQuery:
    text: str
    kind: str


def decompose(question: str) -> list[SubQuery]:
    """At most five sub-queries: a comparison gives its sides, several aspects of one thing each aspect, a conjunction its parts of
    over three characters; else the question itself. Equal sub-queries, by case and outer blanks, come once."""
    q = question.strip()
    if not q:
        return []
    parts: list[SubQuery] = []
    if m := _BETWEEN.match(q) or _VERSUS.match(q):
        tail = f" {m[3]}" if m[3] else ""
        parts = [SubQuery(f"{m[1].strip()}{tail}", "comparison"), SubQuery(f"{m[2].strip()}{tail}", "comparison")]
    elif len(words := _ASPECT_WORDS.findall(q)) > 1 and (m := _ASPECTS.match(q)):
        parts = [SubQuery(f"{m[2].strip()} {w}", "aspect") for w in words]
    elif _AND.search(q):
        split = [p.strip(" ?,") for p in _AND.split(q)]
        parts = [SubQuery(p, "conjunction") for p in split if len(p) > 3]
    if len(parts) < 2:
        return [SubQuery(q, "whole")]
    seen: dict[str, SubQuery] = {}
    for p in parts:
        seen.setdefault(p.text.lower().strip(), p)
    return list(seen.values())[:MOST_PARTS]


def aggregate(results: DataFrame, how: str = "max", key: str = "id", score: str = "score", part: str = "part") -> DataFrame:
    """(key, score) of results of sub-queries (part, key, score): the largest score, the sum, or the mean of scores over their position + 1.

    Null scores count as nothing; a result that comes twice in one sub-query counts twice.
    """
    fine = results.where(F.col(score).isNotNull())
    if how == "weighted":
        place = F.row_number().over(Window.partitionBy(key).orderBy(part, F.desc(score)))
        return fine.withColumn("__s", F.col(score) / place).groupBy(key).agg((F.sum("__s") / F.count("*")).alias(score))
    if how not in ("max", "sum"):
        raise ValueError(f"unknown aggregation {how}")
    return fine.groupBy(key).agg((F.max(score) if how == "max" else F.sum(score)).alias(score))


def token_budget(history_chars: Column, window: int, reserved: int, ratio: float, least_history: int, least_context: int) -> tuple[Column, Column]:
    """Tokens for history and for context: history as needed within its ratio and least, context the rest and at least its least; history gives way."""
    available = max(window - reserved, 0)
    history = F.greatest(F.lit(least_history), F.least(F.floor(history_chars / 4), F.lit(int(ratio * available))))
    context = F.greatest(F.lit(least_context), F.lit(available) - history)
    return F.greatest(F.lit(0), F.least(history, F.lit(available) - context)), context


_REFERENCES = (
    (re.compile(r"\bthe\s+([A-Z][a-z]+)\s+(?:paper|report|document|article)s?\s+(?:from|of)\s+((?:19|20)\d\d)"), 0.95),
    (re.compile(r"\b([A-Z][a-z]+)(?:\s+et\s+al\.?)?\s*\(?((?:19|20)\d\d)\)?"), 0.95),
    (re.compile(r"\bthe\s+([A-Z][a-z]+)\s+(?:paper|report|document|article)"), 0.8),
    (re.compile(r"\b(?:paper|report|document|article)s?\s+(?:from|of)\s+()((?:19|20)\d\d)"), 0.65),
)


def references(question: str) -> list[tuple[str, str | None, float]]:
    """(author, year, confidence) of the documents a question refers to by author, author and year, or year; the surest first."""
    out: dict[tuple[str, str | None], float] = {}
    for pattern, sure in _REFERENCES:
        for m in pattern.finditer(question):
            who = (m[1] or "").lower()
            year = m[2] if m.re.groups > 1 else None
            if not any(who == w and (year is None or y == year) for w, y in out):
                out[(who, year)] = sure
    return sorted(((w, y, c) for (w, y), c in out.items()), key=lambda x: (-x[2], x[0]))


def format_context(rows: DataFrame, group: str, order: str, source: str, content: str, page: str) -> DataFrame:
    """(group, text): each document's chunks in order under a line with its source and pages, joined by [...]."""
    got = rows.groupBy(group).agg(F.min(source).alias("__s"), F.array_sort(F.collect_set(page)).alias("__p"), F.array_sort(F.collect_list(F.struct(order, content))).alias("__c"))
    pages = F.when(F.size("__p") > 0, F.concat(F.lit(", p. "), F.array_join(F.transform("__p", lambda x: x.cast("string")), ", "))).otherwise(F.lit(""))
    text = F.concat(F.coalesce("__s", F.lit("")), pages, F.lit("\n"), F.array_join(F.transform("__c", lambda x: x[content]), "\n[...]\n"))
    return got.select(group, text.alias("text"))


def quality_band(relevance: Column, faithfulness: Column) -> Column:
    """excellent, good, fair or poor, by 0.4 x relevance + 0.6 x faithfulness."""
    s = 0.4 * relevance + 0.6 * faithfulness
    return F.when(s >= 0.8, "excellent").when(s >= 0.6, "good").when(s >= 0.4, "fair").otherwise("poor")
