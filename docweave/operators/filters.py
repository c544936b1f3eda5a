"""JSON-style metadata filters compiled to columns, and tag patterns.

{"k": v} is equality; several keys are joined by AND; {"$and": [...]} and {"$or": [...]} nest; a dict as value holds operators
joined by AND: $eq $ne $gt $gte $lt $lte $in $nin. A missing key makes every comparison null, so the row does not pass, by $ne and
$nin too; an empty $in lets nothing pass, an empty $nin everything. {} lets everything pass.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
}


class FilterError(ValueError):
    """An operator that is not known."""


def _typed(key: str, value: Any, columns: tuple[str, ...], json: str) -> Column:
    """The column of a key, or the JSON field of that name in the type of value; malformed JSON has no fields."""
    if key in columns:
        return F.col(key)
    kind = "boolean" if isinstance(value, bool) else "double" if isinstance(value, (int, float)) else "string"
    path = "$." + key
    return F.try_variant_get(F.try_parse_json(F.col(json)), path, kind)


def _operator(key: str, op: str, value: Any, columns: tuple[str, ...], json: str) -> Column:
    if op in _COMPARE:
        return _COMPARE[op](_typed(key, value, columns, json), F.lit(value))
    if op in ("$in", "$nin"):
        if not value:
            return F.lit(op == "$nin")
        c = _typed(key, value[0], columns, json).isin(list(value))
        return c if op == "$in" else ~c
    raise FilterError(f"unknown operator {op}")


def compile_filter(where: dict[str, Any], columns: tuple[str, ...], json: str = "metadata") -> Column:
    """A filter as one condition; columns are the keys that are columns of the table."""
    parts: list[Column] = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            inner = [compile_filter(w, columns, json) for w in value]
            joined = inner[0] if inner else F.lit(key == "$and")
            for c in inner[1:]:
                joined = joined & c if key == "$and" else joined | c
            parts.append(joined)
        elif isinstance(value, dict):
            parts += [_operator(key, op, v, columns, json) for op, v in value.items()]
        else:
            parts.append(_operator(key, "$eq", value, columns, json))
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def escape_like(text: str) -> str:
    """Text for LIKE with its wildcards taken literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def tag_matches(tags: str | Column, pattern: str) -> Column:
    """Whether one of the tags fits a pattern: equal, or with * for any characters."""
    if "*" not in pattern:
        return F.array_contains(tags, pattern)
    like = escape_like(pattern).replace("*", "%")
    return F.exists(tags, lambda t: t.like(like))


def tag_query(tags: str | Column, include_all: list[str] = (), include_any: list[str] = (), exclude: list[str] = ()) -> Column:
    """All of include_all, one of include_any (if any are given), none of exclude; three empty lists let everything pass."""
    out = F.lit(True)
    for p in include_all:
        out = out & tag_matches(tags, p)
    if include_any:
        some = F.lit(False)
        for p in include_any:
            some = some | tag_matches(tags, p)
        out = out & some
    for p in exclude:
        out = out & ~tag_matches(tags, p)
    return out


def tag_query_text(include_all: list[str], include_any: list[str], exclude: list[str]) -> str:
    """A tag query to read."""
    parts = [" AND ".join(include_all), f"({' OR '.join(include_any)})" if include_any else "", *(f"NOT {x}" for x in exclude)]
    return " AND ".join(p for p in parts if p) or "(all)"
