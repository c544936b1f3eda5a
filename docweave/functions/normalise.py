"""Repair of extracted text that needs a vocabulary: spaced letters, joined words, ligatures, broken lines, main content.

Each function takes a set of known words in lower case; pass the words of a corpus or a word list read from a file.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACED = re.compile(r"\b(?:[^\W\d_] ){2,}[^\W\d_]\b")
# Signs of joined letters and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st", "Œ": "OE", "œ": "oe", "Æ": "AE", "æ": "ae"}
# Small words that run together with the word after them, and with the word before them.
BEFORE = "a an the is it to in on of or as at by we be if so no do my up he me".split()
AFTER = "the and for are but not you all can had her was one our out has his how man new now old see way who its say she two may day".split()
#: More words that run together with the word before them.
AFTER_TOO = "of in to with by from".split()


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word): one word a line of a text file, trimmed and in lower case, blank lines left out, each once."""
    return spark.read.text(path).select(F.lower(F.btrim("value")).alias("word")).where("word <> ''").distinct()


def join_spaced_letters(text: str, words: set[str]) -> str:
    """Three or more single letters apart become a word where they spell a known one."""

    def fix(m: re.Match) -> str:
        joined = m[0].replace(" ", "")
        return joined if joined.lower() in words else m[0]

    return _SPACED.sub(fix, text)


def split_joined_words(text: str, words: set[str]) -> str:
    """An unknown word that is a small word and a known one run together is parted; the longest small word wins."""
    first, last = (sorted(x, key=lambda w: (-len(w), w)) for x in (BEFORE, AFTER + AFTER_TOO))

    def fix(m: re.Match) -> str:
        w = m[0]
        low = w.lower()
        if low in words:
            return w
        for s in first:
            if low.startswith(s) and len(low) > len(s) + 2 and low[len(s) :] in words:
                return f"{w[: len(s)]} {w[len(s) :]}"
        for s in last:
            if low.endswith(s) and len(low) > len(s) + 2 and low[: -len(s)] in words:
                return f"{w[: -len(s)]} {w[-len(s) :]}"
        return w

    return re.sub(r"[^\W\d_]+", fix, text)


def expand_ligatures(text: str) -> str:
    return text.translate(str.maketrans(LIGATURES))


def join_broken_lines(text: str, least: int = 30) -> str:
    """A line goes on in the next one if it is longer than least, ends in no sentence and the next begins in lower case."""
    out: list[str] = []
    for line in text.split("\n"):
        if out and len(out[-1]) > least and not re.search(r"[.!?:]\s*$", out[-1]) and re.match(r"\s*[^\W\d_A-ZÀ-Þ]", line):
            out[-1] = f"{out[-1].rstrip()} {line.lstrip()}"
        else:
            out.append(line)
    return "\n".join(out)


def main_content(text: str, shortest: int = 40) -> str:
    """The run of paragraphs with the largest sum of scores: length and sentences count for a paragraph, list marks and capitals against it."""
    parts = re.split(r"\n\s*\n", text)

    def score(p: str) -> float:
        s = len(p) + 20 * len(re.findall(r"[.!?](?:\s|$)", p)) - 10 * len(re.findall(r"(?m)^\s*[-•*]", p)) - 5 * sum(c.isupper() for c in p)
        return s if len(p) >= shortest else s - 2 * shortest

    best, here, start, span = 0.0, 0.0, 0, (0, len(parts))
    for i, p in enumerate(parts):  # the best contiguous sum in one pass
        if here <= 0:
            here, start = 0.0, i
        here += score(p)
        if here > best:
            best, span = here, (start, i + 1)
    return "\n\n".join(parts[span[0] : span[1]])


def classify_block(text: str) -> str:
    """list, table, code, heading, caption, boilerplate, short or content."""
    s = text.strip()
    if not s:
        return "short"
    lines = s.split("\n")
    if all(re.match(r"\s*[-•*\d]", x) for x in lines):
        return "list"
    if sum("|" in x for x in lines) * 2 > len(lines):
        return "table"
    if re.search(r"(?m)^(?: {4}|\t)\S|[{};]\s*$", s):
        return "code"
    if re.match(r"(?i)(figure|fig\.|table|abb\.)\s*\d", s):
        return "caption"
    if re.match(r"#{1,6} ", s) or (len(lines) == 1 and len(s) < 80 and not re.search(r"[.!?]$", s)):
        return "heading"
    if re.search(r"(?i)\b(cookie|copyright|all rights reserved|subscribe|log ?in)\b", s) and len(s) < 300:
        return "boilerplate"
    if len(s) < 50:
        return "short"
    return "content"


def similarity(a: str, b: str) -> float:
    """The share of matching runs of two texts, 0 to 1; 1 for two empty ones."""
    import difflib

    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a or b else 1.0
