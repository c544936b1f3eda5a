"""Visually identical text with different characters, brought to one consistent form.

Compatibility normalisation (NFKC), mapped white space, removal of default-ignorable characters, and
the look-alike letters of other scripts; full case folding on request. Each distinct text is
normalised once for every Arrow batch, with one translation table over all its characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.session import Scratch

# Unicode's Default_Ignorable_Code_Point ranges.
IGNORABLE = "00AD 034F 061C 115F-1160 17B4-17B5 180B-180F 200B-200F 202A-202E 2060-206F 3164 FE00-FE0F FEFF FFA0 FFF0-FFF8 1BCA0-1BCA3 1D173-1D17A E0000-E0FFF"

# Letters of other scripts that are drawn like Latin ones, pair by pair.
LOOKALIKES = {
    "Cyrillic": "аa вʙ еe зз оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl гr АA ВB ЕE ЗЗ ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ЅS ԚQ ԜW ԌG ҮY Ӏl ѵv ѴV ґґ",
    "Greek": "αα οo νv υυ ρρ ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϲc Ϲc ϳj ιι ϜF",
    "Armenian": "օo ոn սu հh ցg զq ՕO ՍU ԼL",
    "Latin": "ɑa ɡg ɩi ſs ıı",
}

# Signs that are drawn alike and stay apart under NFKC.
SIGNS = {
    "-": "‐‑⁃﹣－",
    "'": "‘’‛ʼʹ′＇ʻ",
    '"': "“”‟″＂ʺ",
    "/": "⁄∕",
    ":": "∶꞉",
    "*": "∗",
    "|": "∣ǀ",
    ".": "․",
    "~": "∼",
}


def _ranges(text: str) -> list[int]:
    out: list[int] = []
    for part in text.split():
        first, _, last = part.partition("-")
        out += range(int(first, 16), int(last or first, 16) + 1)
    return out


def _build() -> dict[int, str | None]:
    table: dict[int, str | None] = dict.fromkeys(_ranges(IGNORABLE))
    for pairs in LOOKALIKES.values():
        table |= {ord(p[0]): p[1:] for p in pairs.split() if len(p) == 2}
    for sign, others in SIGNS.items():
        table |= {ord(c): sign for c in others}
    return table


_TABLE: dict[int, str | None] = _build()
_LETTERS = {k: v for k, v in _TABLE.items() if v is None or v.isalpha()}
_IGNORED = {k: None for k, v in _TABLE.items() if v is None}
#: Raised and lowered characters differ to the eye from the plain ones, so they are kept from NFKC behind private characters.
_RAISED = [c for c in range(0x20000) if unicodedata.decomposition(chr(c)).startswith(("<super>", "<sub>"))]
_HIDE = {c: 0xF0000 + i for i, c in enumerate(_RAISED)}
_HIDDEN = _IGNORED | _HIDE
_SHOW = {v: k for k, v in _HIDE.items()}
_SPACE = re.compile(r"[\s\u0085\u180e\u2800]+")
_PLAIN = re.compile(r"[!-~]+(?: [!-~]+)*")
_SPECIAL = frozenset(map(chr, _TABLE))


def unify(text: str | None, casefold: bool = False, map_signs: bool = True) -> str | None:
    """One text in the consistent form; null stays null, a blank text becomes the empty text.

    Two texts have one form if they have the same letters, accents, case, digits and signs in the same order,
    whatever characters or widths draw them; blanks count as one between words and as none at the ends.
    casefold drops the difference of case too, by full folding.
    """
    if text is None:
        return None
    if text.isascii() or (unicodedata.is_normalized("NFKC", text) and _SPECIAL.isdisjoint(text)):
        text = text if _PLAIN.fullmatch(text) else _SPACE.sub(" ", text).strip()
    else:
        # decomposed first, so that an accent on a look-alike letter of another script composes with its Latin form
        text = unicodedata.normalize("NFKD", text.translate(_HIDDEN))
        text = unicodedata.normalize("NFKC", text.translate(_TABLE if map_signs else _LETTERS)).translate(_SHOW)
        text = _SPACE.sub(" ", text).strip()
    return unicodedata.normalize("NFKC", text.casefold()) if casefold else text


def unify_column(text: str | Column, casefold: bool = False, map_signs: bool = True) -> Column:
    """unify() as a column: a vectorised function, one call for each distinct value of a batch."""

    @F.pandas_udf("string")
    def one_form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            codes, values = pd.factorize(s)
            done = [unify(v, casefold, map_signs) for v in values] + [None]
            yield pd.Series([done[c] for c in codes], dtype="object")

    return one_form(F.col(text) if isinstance(text, str) else text)


def look_alike_pairs(rows: DataFrame, key: str, text: str, rows_per_part: int = 1000, scratch: Scratch | None = None) -> DataFrame:
    """(key_a, key_b, key_a < key_b): pairs of rows whose texts differ but have the same form.

    Null and blank texts take no part; a row that was delivered twice counts once. Forms are compared through 192 bits of hashes. Classes of more than
    rows_per_part rows are split: their left sides are salted and right sides repeated, so each pair still comes once.
    The pairs of a class are the result itself here; of texts without a second spelling nothing is joined.
    """
    base = rows.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length(F.btrim("t")) > 0)
    # texts stay where they are: only hashes of a text and of its form are moved
    forms = base.select("k", F.xxhash64("t").alias("own"), unify_column("t").alias("form"))
    forms = forms.where(F.col("form") != "").select("k", "own", F.xxhash64("form").alias("h"), F.md5("form").alias("f")).distinct()
    # three joins read the forms, so they are written once: 56 bytes a row
    forms = (scratch or Scratch(rows.sparkSession, "forms")).write("forms", forms)
    # only classes with two different texts have pairs
    classes = forms.groupBy("h", "f").agg(F.count("*").alias("n"), F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo < hi")
    left = forms.join(classes.select("h", "f", "n"), ["h", "f"])
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(rows_per_part))).cast("int")
    a = left.select("h", "f", F.col("k").alias("key_a"), F.col("own").alias("own_a"), F.pmod(F.xxhash64("k"), parts).cast("int").alias("salt"))
    b = left.select("h", "f", F.col("k").alias("key_b"), F.col("own").alias("own_b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    pairs = a.join(b, ["h", "f", "salt"]).where((F.col("key_a") < F.col("key_b")) & (F.col("own_a") != F.col("own_b")))
    return pairs.select("key_a", "key_b")


def look_alike_classes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(form, rows, spellings, first): one row a consistent form that several texts share, with how many rows and different texts have it, and its smallest key.

    Null and blank texts take no part; a row that was delivered twice counts once. Nothing grows with the pairs of a class.
    """
    base = rows.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length(F.btrim("t")) > 0)
    forms = base.select("k", F.xxhash64("t").alias("own"), unify_column("t").alias("form")).where(F.col("form") != "")
    # of each row the hash of its form moves, and of each form one copy of its text
    named = forms.select("k", "own", F.xxhash64("form").alias("h"), F.md5("form").alias("f"), "form")
    each = named.groupBy("h", "f", "own").agg(F.count_distinct("k").alias("n"), F.min("k").alias("first"), F.first("form").alias("form"))
    whole = each.groupBy("h", "f").agg(F.first("form").alias("form"), F.sum("n").alias("rows"), F.count("*").alias("spellings"), F.min("first").alias("first"))
    return whole.where("spellings > 1").select("form", "rows", "spellings", "first")
