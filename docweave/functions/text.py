"""Text functions as columns: tokens, clean-up, hashes, sizes, sentences."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.keys import as_column

ZERO_WIDTH = "​‌‍⁠﻿"


def _accents() -> tuple[str, str]:
    """The letters whose canonical decomposition is one sign and marks, and these signs."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x2200)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


_ACCENTED, _PLAIN = _accents()
#: Combining marks have no counterpart in _PLAIN, so translate leaves them out.
_ACCENTED += "".join(chr(c) for c in range(0x300, 0x370))
#: What parts words.
NO_WORD = r"[^\p{L}\p{N}]+"


def folded(text: str | Column) -> Column:
    """Lower case without accents and combining marks."""
    t = as_column(text)
    # texts without a letter of several bytes have no accent
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(F.lower(t), _ACCENTED, _PLAIN))


def tokens(text: str | Column) -> Column:
    """Runs of letters and digits in lower case, accents folded; null for null text."""
    return F.filter(F.split(folded(text), NO_WORD), lambda t: t != "")


def token_count(text: str | Column) -> Column:
    """The canonical size in tokens: characters div 4."""
    return F.floor(F.length(as_column(text)) / 4).cast("int")


def universal_fixes(text: str | Column) -> Column:
    """No zero-width characters, single blanks, trimmed lines, at most one empty line in a row, trimmed text."""
    out = F.translate(as_column(text), ZERO_WIDTH, "")
    out = F.regexp_replace(out, "\r\n?", "\n")
    out = F.regexp_replace(out, "[ \t]+", " ")
    out = F.regexp_replace(out, " ?\n ?", "\n")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return F.btrim(out, F.lit(" \n\t"))


def html_line_breaks(text: str | Column) -> Column:
    """Lines that go on in lower case are joined; words hyphenated across lines are made whole; blanks collapse."""
    out = F.regexp_replace(as_column(text), "([a-z])-\n([a-z])", "$1$2")
    out = F.regexp_replace(out, "([a-z,;])\n([a-z])", "$1 $2")
    out = F.regexp_replace(out, "[ \t]+", " ")
    return F.regexp_replace(out, "\n{3,}", "\n\n")


def keep_lines(text: str | Column, unwanted: str) -> Column:
    """The lines that do not match the pattern from their start."""
    lines = F.split(as_column(text), "\n")
    return F.array_join(F.filter(lines, lambda x: ~F.lower(x).rlike(unwanted)), "\n")


def content_hash(text: str | Column) -> Column:
    """The first 32 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(as_column(text), 256), 1, 32)


def document_id(path: str | Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256 of a path."""
    return F.substring(F.sha2(as_column(path), 256), 1, 16)


def url_domain(url: str | Column) -> Column:
    """The host of a URL in lower case, without port and leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(as_column(url), "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)), "^www\\.", "")


def title_from_filename(name: str | Column) -> Column:
    """A file name's stem with separators as blanks, words capitalised."""
    stem = F.regexp_replace(F.regexp_replace(as_column(name), "^.*/", ""), "\\.[^.]+$", "")
    return F.initcap(F.btrim(F.regexp_replace(stem, "[-_.]+", " ")))


def shorten(text: str | Column, most: int) -> Column:
    """White space collapsed; a longer text ends in three dots at the given length."""
    flat = F.btrim(F.regexp_replace(as_column(text), "[ \t\r\n]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def count_matches(text: str | Column, pattern: str) -> Column:
    """How often a pattern occurs; 0 in null."""
    return F.coalesce(F.regexp_count(as_column(text), F.lit(pattern)), F.lit(0))
