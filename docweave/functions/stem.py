"""Words for a keyword index: accents folded, cut at everything but letters and digits, suffixes stripped.

The suffix rules are those of the algorithm that Porter published in 1980.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.keys import as_column

_MOST_WORDS = 200_000
_WORD = re.compile(r"[^\W_]+")
# The published suffix tables, suffix and replacement.
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _table(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(x.split(":")) for x in text.split()), key=lambda p: -len(p[0]))


_TWO, _THREE, _FOUR = _table(STEP_2), _table(STEP_3), sorted(STEP_4.split(), key=lambda x: -len(x))


def _shape(word: str) -> str:
    """c or v for every letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, table: list[tuple[str, str]]) -> str:
    for suffix, new in table:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


def stem(word: str) -> str:
    """The stem of one word in lower case; words of up to two letters and words with other signs than a to z stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _shape(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _TWO), _THREE)
    for suffix in _FOUR:
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


class _Stems(dict):
    def __missing__(self, word: str) -> str:
        if len(self) > _MOST_WORDS:
            self.clear()
        self[word] = s = stem(word)
        return s


_stems = _Stems()


def index_words(text: str | None, stemmed: bool = True) -> list[str]:
    """The index's words of a text, in order; none for null."""
    found = _WORD.findall(fold(text)) if text else []
    return [_stems[w] for w in found] if stemmed else found


def index_tokens(text: str | Column, stemmed: bool = True) -> Column:
    """index_words() as an array column; an empty array for null. A vectorised function with one memo of stems for a worker."""

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([index_words(t, stemmed) for t in s], dtype="object")

    return cut(as_column(text))
