"""Chunkers: pieces of a text with their place, by sentences, fixed windows, separators, structure or elements."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE = "array<struct<index:int,start:int,stop:int,content:string,tokens:int>>"
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-ZÀ-Þ¿¡])|\n\s*\n|(?<=:)\n")
# Where the recursive chunker cuts, strongest first.
SEPARATORS = ("\n## ", "\n# ", "\n\n\n", "\n\n", "\n", ". ", " ")


def _size(n: int) -> int:
    return n // 4


def _spans(text: str, cut: re.Pattern) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in cut.finditer(text):
        out.append((at, m.end()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def by_sentence(text: str, size: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Sentences packed greedily up to size tokens; the next chunk begins with the last sentences of at most overlap tokens.

    A last chunk under least tokens joins the one before. A sentence longer than size is a chunk of its own.
    """
    spans = _spans(text, _SENTENCE)
    out: list[tuple[int, int]] = []
    i = 0
    while i < len(spans):
        j = i + 1
        while j < len(spans) and _size(spans[j][1] - spans[i][0]) <= size:
            j += 1
        out.append((spans[i][0], spans[j - 1][1]))
        if j == len(spans):
            break
        back = j
        while overlap > 0 and back - 1 > i and _size(spans[j - 1][1] - spans[back - 1][0]) <= overlap:
            back -= 1
        i = back
    if len(out) > 1 and _size(out[-1][1] - out[-1][0]) < least:
        last = out.pop()
        out[-1] = (out[-1][0], last[1])
    return out


def by_window(text: str, size: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Windows of size tokens that end at a blank where there is one in their second half; each begins overlap tokens before the end of the last, and always later than it."""
    out, at, wide, back = [], 0, size * 4, overlap * 4
    while at < len(text):
        stop = min(len(text), at + wide)
        if stop < len(text) and (blank := text.rfind(" ", at + wide // 2, stop)) > 0:
            stop = blank
        out.append((at, stop))
        if stop >= len(text):
            break
        at = max(stop - back, at + 1)
    return out


def by_separators(text: str, size: int, overlap: int, least: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Parts between the first separator the text has, packed up to size tokens; a part over size is cut at the next separators.

    A packed part under least tokens joins the chunk before it; the first of a text stays, so that nothing is lost. What no
    separator cuts stays whole. A separator belongs to the part before it, the mark of a heading to the heading, and does not count to its size.
    """

    def split(a: int, b: int, seps: tuple[str, ...]) -> list[tuple[int, int]]:
        while seps and text.find(seps[0], a, b) < 0:
            seps = seps[1:]
        if not seps:
            return [(a, b)]
        sep = seps[0]
        parts, at, seek = [], a, a
        while (hit := text.find(sep, seek, b)) >= 0:
            cut = hit + (1 if sep.endswith("# ") else len(sep))  # the mark of a heading stays with the heading
            parts.append((at, hit, cut))
            at, seek = cut, hit + len(sep)
        parts.append((at, b, b))
        out: list[tuple[int, int]] = []
        run: tuple[int, int, int] | None = None

        def close() -> None:
            if run and out and _size(run[1] - run[0]) < least:
                out[-1] = (out[-1][0], run[2])
            elif run:
                out.append((run[0], run[2]))

        for begin, end, stop in parts:
            if not text[begin:stop].strip():
                continue
            if run and _size(end - run[0]) <= size:
                run = (run[0], end, stop)
                continue
            close()
            run = None
            if _size(end - begin) > size and len(seps) > 1:
                inner = split(begin, end, seps[1:])
                inner[-1] = (inner[-1][0], stop)
                out += inner
            else:
                run = (begin, end, stop)
        close()
        return out or [(a, b)]

    return split(0, len(text), separators)


_FENCE = re.compile(r"(?ms)^```.*?^```[^\n]*$|^\|.+\|[ \t]*\n\|[-:\s|]+\|[ \t]*\n(?:\|.+\|[ \t]*\n?)+")
_HEADING = re.compile(r"(?m)^#{1,6}\s+\S")


def paragraphs(text: str, a: int, b: int, whole: int) -> list[tuple[int, int]]:
    """The spans between blank lines; code blocks and tables of at most whole tokens are not cut inside."""
    kept = [(m.start(), m.end()) for m in _FENCE.finditer(text, a, b) if _size(m.end() - m.start()) <= whole]
    cuts = [m.end() for m in re.compile(r"\n\s*\n").finditer(text, a, b) if not any(x < m.end() < y for x, y in kept)]
    ends = sorted({*cuts, *(y for _, y in kept), *(x for x, _ in kept if x > a), b})
    out, at = [], a
    for e in ends:
        if text[at:e].strip():
            out.append((at, e))
        at = max(at, e)
    return out


def by_structure(text: str, size: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Sections under headings; one over size tokens is cut into packed paragraphs, a paragraph over size into packed sentences.

    Code blocks and tables that fit are not cut. A chunk under least tokens joins its neighbour up to 1.2 x size.
    """
    starts = [0, *(m.start() for m in _HEADING.finditer(text) if m.start())]
    out: list[tuple[int, int]] = []
    for a, b in zip(starts, [*starts[1:], len(text)]):
        if not text[a:b].strip():
            continue
        if _size(b - a) <= size:
            out.append((a, b))
            continue
        run: tuple[int, int] | None = None
        for x, y in paragraphs(text, a, b, size):
            if run and _size(y - run[0]) <= size:
                run = (run[0], y)
                continue
            if run:
                out.append(run)
            run = None
            if _size(y - x) > size:
                out += [(x + p, x + q) for p, q in by_sentence(text[x:y], size, 0, 0)]
            else:
                run = (x, y)
        if run:
            out.append(run)
    merged: list[tuple[int, int]] = []
    for a, b in out:
        small = merged and min(_size(merged[-1][1] - merged[-1][0]), _size(b - a)) < least
        if small and _size(b - merged[-1][0]) <= 1.2 * size:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


def by_elements(text: str, size: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Code blocks, tables, lists, headings and paragraphs as elements, a heading with the element after it, packed up to size.

    The size of an element is 1.3 tokens a word. An element over size is cut by sentences.
    """
    tokens = lambda x, y: int(len(text[x:y].split()) * 1.3)
    elements: list[tuple[int, int]] = []
    heading: int | None = None
    for a, b in paragraphs(text, 0, len(text), len(text)):
        begin = a if heading is None else heading
        heading = begin if _HEADING.match(text[a:b].lstrip()) and "\n" not in text[a:b].strip() else None
        if heading is None:
            elements.append((begin, b))
    if heading is not None:
        elements.append((heading, len(text)))
    out: list[tuple[int, int]] = []
    open_run = False
    for a, b in elements:
        if tokens(a, b) > size:
            out += [(a + p, a + q) for p, q in by_sentence(text[a:b], size, 0, 0)]
            open_run = False
        elif open_run and tokens(out[-1][0], b) <= size:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
            open_run = True
    return out


STRATEGIES = {"sentence": by_sentence, "fixed": by_window, "recursive": by_separators, "structure": by_structure, "elements": by_elements}


def chunk(text: str | None, strategy: str = "sentence", size: int = 512, overlap: int = 50, least: int = 100) -> list[dict] | None:
    """The chunks of a text; none for an empty or blank one, null for null. An unknown strategy is that by sentences."""
    if text is None:
        return None
    spans = STRATEGIES.get(strategy, by_sentence)(text, size, overlap, least) if text.strip() else []
    return [{"index": i, "start": a, "stop": b, "content": text[a:b], "tokens": _size(b - a)} for i, (a, b) in enumerate(spans)]


def chunk_column(text: str | Column, strategy: str = "sentence", size: int = 512, overlap: int = 50, least: int = 100) -> Column:
    @F.pandas_udf(SHAPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([chunk(t, strategy, size, overlap, least) for t in s], dtype="object")

    return run(F.col(text) if isinstance(text, str) else text)


def fixed_windows(text: str, size: int, overlap: int) -> Column:
    """Unaligned windows by built-in functions only: an array of (start, content)."""
    step, wide = (size - overlap) * 4, size * 4
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return F.when(F.length(text) > 0, F.transform(starts, lambda a: F.struct(a.alias("start"), F.substring(F.col(text), a + 1, F.lit(wide)).alias("content"))))
