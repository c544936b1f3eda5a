"""Splitting of oversized texts at natural boundaries by agglomerative merging.

A text begins as atomic segments (words with the blanks after them). Adjacent segments wait in a heap, the pair
with the weakest boundary first: inside a word, between words, after a comma or line, between sentences, between
paragraphs. Pairs are merged while the combined segment and the overlap before it fit the limit. What stays
apart are the pieces, so cuts lie on the strongest boundaries that the limit allows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = "array<struct<piece:int,start:int,stop:int,core:int,content:string,boundary:string>>"
INSIDE, WORD, CLAUSE, SENTENCE, PARAGRAPH = range(5)
NAMES = ("inside", "word", "clause", "sentence", "paragraph")
MOST_SETTINGS = 1000
_ATOM = re.compile(r"\s*\S+\s*|\s+")
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_CLAUSE_END = re.compile(r"[,;:]$")


def _strength(atom: str) -> int:
    """How strong the boundary after an atom is."""
    word = atom.rstrip()
    blanks = atom[len(word) :]
    if not blanks:
        return INSIDE
    lines = blanks.replace("\r\n", "\n").replace("\r", "\n").count("\n")
    if lines > 1:
        return PARAGRAPH
    if _SENTENCE_END.search(word):
        return SENTENCE
    return CLAUSE if lines or _CLAUSE_END.search(word) else WORD


def merge_segments(text: str, room: int) -> list[tuple[int, int, int]]:
    """(start, stop, strength of the boundary at stop) of segments of at most room characters that make up text."""
    starts: list[int] = []
    stops: list[int] = []
    strong: list[int] = []
    for m in _ATOM.finditer(text):
        a, b = m.span()
        level = _strength(m.group())
        while b - a > room:  # a word longer than the limit is cut where it must be
            starts.append(a)
            stops.append(a + room)
            strong.append(INSIDE)
            a += room
        starts.append(a)
        stops.append(b)
        strong.append(level)
    n = len(starts)
    after = [*range(1, n), -1]
    before = [*range(-1, n - 1)]
    heap = [(strong[i], stops[i + 1] - starts[i], i, i + 1) for i in range(n - 1) if stops[i + 1] - starts[i] <= room]
    heapq.heapify(heap)
    gone = [False] * n
    while heap:
        level, size, i, j = heapq.heappop(heap)
        if gone[i] or gone[j] or after[i] != j or stops[j] - starts[i] != size:
            continue  # an older pair; the newer one is in the heap if it fits
        gone[j] = True
        stops[i], strong[i], after[i] = stops[j], strong[j], after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and stops[y] - starts[x] <= room:
                heapq.heappush(heap, (strong[x], stops[y] - starts[x], x, y))
    return [(starts[i], stops[i], strong[i]) for i in range(n) if not gone[i]]


def word_start(text: str, at: int, least: int) -> int:
    """The start of the word that at lies in, if that is not before least; else at."""
    begin = at
    while begin > least and not text[begin - 1].isspace():
        begin -= 1
    return begin if begin == 0 or text[begin - 1].isspace() else at


def split_text(text: str | None, chunk_size: int | None, overlap: int | None, chars_per_token: int = 4) -> list[dict] | None:
    """The pieces of one text: none for null, one for a text within the limit.

    Sizes are in tokens of chars_per_token characters: a piece of n characters has n div chars_per_token tokens.
    Each piece is text[start:stop]; text[core:stop] is its own part, and the own parts joined are the text. The
    characters from start to core are the overlap: the configured number, or all there are before the first cuts, and the rest of the
    word it would begin in, where the limit has room for that. A null size means no limit; an overlap that is null or negative counts
    as nothing, one over half the limit as half of it.
    """
    if text is None:
        return None
    limit = (max(chunk_size, 1) + 1) * chars_per_token - 1 if chunk_size is not None else max(len(text), 1)
    if len(text) <= limit:
        return [{"piece": 0, "start": 0, "stop": len(text), "core": 0, "content": text, "boundary": "end"}]
    shared = min(max(overlap or 0, 0) * chars_per_token, limit // 2)
    out = []
    segments = merge_segments(text, limit - shared)
    for k, (a, b, level) in enumerate(segments):
        start = word_start(text, max(0, a - shared), max(0, b - limit)) if shared else a
        out.append({"piece": k, "start": start, "stop": b, "core": a, "content": text[start:b], "boundary": NAMES[level] if k + 1 < len(segments) else "end"})
    return out


def split_column(text: Column, chunk_size: Column, overlap: Column) -> Column:
    @F.pandas_udf(PIECES)
    def pieces(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, size, over in batches:
            yield pd.Series([split_text(a, None if pd.isna(b) else int(b), None if pd.isna(c) else int(c)) for a, b, c in zip(t, size, over)], dtype="object")

    return pieces(text, chunk_size, overlap)


def with_limits(rows: DataFrame, config: DataFrame, metadata: str = "metadata", default: str = "sentence") -> DataFrame:
    """rows with chunk_size and overlap of the strategy named in their metadata; the default's where it names none that is listed.

    config is a table of settings with one row a strategy; its rows become expressions of the plan, so more than
    MOST_SETTINGS are an error.
    """
    listed = config.limit(MOST_SETTINGS + 1).collect()
    if len(listed) > MOST_SETTINGS:
        raise ValueError(f"more than {MOST_SETTINGS} settings")
    settings = {r["strategy"]: (r["chunk_size"], r["overlap"]) for r in listed}
    named = F.try_variant_get(F.try_parse_json(F.col(metadata)), "$.strategy", "string")
    size, over = (F.lit(settings.get(default, (None, None))[i]).cast("int") for i in (0, 1))
    for strategy, (a, b) in settings.items():
        hit = F.coalesce(named == strategy, F.lit(False))
        size, over = F.when(hit, F.lit(a)).otherwise(size), F.when(hit, F.lit(b)).otherwise(over)
    return rows.withColumns({"chunk_size": size, "overlap": over})


def oversized(rows: DataFrame, text: str, chars_per_token: int = 4) -> DataFrame:
    """rows (with chunk_size) whose text is longer than the limit."""
    return rows.where(F.floor(F.length(text) / F.lit(chars_per_token)) > F.col("chunk_size"))


def split_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, piece, start, stop, core, content, boundary): the pieces of every row that is over its limit.

    rows need chunk_size and overlap. Null, empty and small texts do not come out; rows repeated under a key are split once.
    """
    big = oversized(rows.select(key, F.col(text).alias("__text"), "chunk_size", "overlap"), "__text").dropDuplicates([key])
    # the exchange that makes one row of each key also spreads the long texts, which are few and dear
    pieces = big.select(key, F.explode(split_column(F.col("__text"), F.col("chunk_size"), F.col("overlap"))).alias("__p"))
    return pieces.select(key, "__p.*")
