"""Scores of extracted text, personal data, citations and languages as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.stem import fold
from docweave.functions.text import count_matches, tokens

# Frequent words of each language.
STOP_WORDS = {
    "de": "und die der das nicht wurde weil mit aus den von ist ein eine im auf für dem sich auch werden wird sind nach bei zu als an es oder".split(),
    "en": "the and of was with from that were to is for in on as by are this be it at or an not has have which will but".split(),
    "es": "el los las por del una que se la de en con para un es como su al lo fue ser pero sus más este ya no".split(),
    "fr": "le les des du une est et dans pour que en la un sur pas par plus au avec ce qui il sont ses aux ne cette était".split(),
}


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.7, "C").when(score >= 0.6, "D").otherwise("F")


def _plain(word: str) -> str:
    return fold(word)


def language(text: str) -> Column:
    """The language with most stop words; ties go to the first in alphabetical order, null without any."""
    return language_scores(text)["code"]


def language_scores(text: str) -> Column:
    """(n, o, code): the stop words of the language that has most, and its code; null without any."""
    t = tokens(text)
    counts = [F.struct(F.size(F.filter(t, _among(words))).alias("n"), F.lit(-i).alias("o"), F.lit(code).alias("code")) for i, (code, words) in enumerate(STOP_WORDS.items())]
    best = F.greatest(*counts)
    return F.when(best["n"] > 0, best)


def language_confidence(text: str) -> Column:
    """The share of the language's stop words among those of all languages; 0 without any."""
    t = tokens(text)
    counts = [F.size(F.filter(t, _among(words))) for words in STOP_WORDS.values()]
    return F.round(F.coalesce(_share(F.greatest(*counts) * 1.0, sum(counts[1:], counts[0])), F.lit(0.0)), 4)


def _among(words: list[str]):
    return lambda x: x.isin(*sorted({_plain(w) for w in words}))


def citation_markers(text: str | Column) -> Column:
    """The distinct numbers of [1] and [1;2] markers, in order."""
    t = F.col(text) if isinstance(text, str) else text
    groups = F.regexp_extract_all(t, F.lit(r"\[([0-9]+(;[0-9]+)*)\]"), 1)
    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ";"))), lambda x: x.cast("int"))))


def format_citation(style: str, title: Column, author: Column, year: Column, name: Column) -> Column:
    """A citation in APA, MLA, Chicago, BibTeX, Markdown or inline style; missing parts are left out."""
    who, when = F.coalesce(author, name), F.coalesce(year, F.lit("n.d."))
    if style == "apa":
        return F.concat(who, F.lit(" ("), when, F.lit("). "), title, F.lit("."))
    if style == "mla":
        return F.concat(who, F.lit('. "'), title, F.lit('." '), when, F.lit("."))
    if style == "chicago":
        return F.concat(who, F.lit(". "), title, F.lit(". "), when, F.lit("."))
    if style == "bibtex":
        return F.concat(F.lit("@misc{"), F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit(", title={"), title, F.lit("}, year={"), when, F.lit("}}"))
    if style == "markdown":
        return F.concat(F.lit("["), title, F.lit("]("), name, F.lit(")"))
    if style == "inline":
        return F.concat(F.lit("("), who, F.lit(", "), when, F.lit(")"))
    raise ValueError(f"unknown style {style}")


# Quality of an extraction, over the whole text. file_type is a column or None (unknown).

#: Characters of broken encodings; each match counts with its length.
BROKEN = (r"�+", r"â€[™œ]", r"Ã[\x80-\xbf]", "ï»¿", r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
#: Python's meaning of ^, dot, white space and digits in Java's patterns.
_AS = "(?mdU)"
STRUCTURE = (r"^#{1,6}\s+\S", r"^\s*[-*+]\s+\S|^\s*\d+\.\s+\S", r"\[.+?\]\(.+?\)", r"\*\*.+?\*\*|__.+?__|_[^_]+_|\*[^*]+\*", r"```[\s\S]*?```|`[^`]+`")
IMAGES = {"placeholder": r"\[(?:Image|Figure|Fig\.?)\s*(?:\d+)?[:\s]*([^\]]*)\]", "caption": r"(?:Caption|Figure|Image)\s*\d*[:\s]+.{10,}", "markdown": r"!\[([^\]]*)\]\([^)]+\)"}
TABLES = {"row": r"\|[^|]+\|", "header": r"\|[-:]+\|", "placeholder": r"\[(?:Table)\s*(?:\d+)?[:\s]*([^\]]*)\]"}
RATIOS = {"pdf": (0.02, 0.5), "html": (0.1, 0.8), "txt": (0.8, 1.0), "md": (0.7, 1.0)}
RECOGNITION_ERRORS = (r"\bl\d\b", r"\bO\d\b", r"[^\w\s]{3,}", r"\b[A-Z]{2,}[a-z]+[A-Z]+")
HEADERS, LISTS = r"^#+\s|\n#{1,6}\s", r"^\s*[-*•]\s|\n\s*\d+\."
WEIGHTS = {"completeness": 0.30, "characters": 0.25, "structure": 0.20, "images": 0.15, "tables": 0.10}


def _is(file_type: Column | None, name: str) -> Column:
    return F.lit(False) if file_type is None else F.coalesce(file_type == name, F.lit(False))


def _has(text: str, pattern: str, flags: str = _AS) -> Column:
    return F.coalesce(F.col(text).rlike(flags + pattern), F.lit(False))


def extraction_completeness(text: str, file_size: Column, file_type: Column | None = None) -> Column:
    """The text's length over the file's size, against the range usual for the type; 0 for an empty file, null without a size."""
    low, high = F.lit(0.05), F.lit(0.5)
    for name, (a, b) in RATIOS.items():
        low, high = F.when(_is(file_type, name), a).otherwise(low), F.when(_is(file_type, name), b).otherwise(high)
    ratio = F.try_divide(F.coalesce(F.length(text), F.lit(0)).cast("double"), file_size)
    score = F.when(ratio < low * 0.1, ratio / (low * 0.1) * 0.3).when(ratio < low, 0.3 + (ratio - low * 0.1) / (low * 0.9) * 0.4)
    score = score.when(ratio <= high, 0.7 + (ratio - low) / (high - low) * 0.3).otherwise(F.greatest(F.lit(0.5), 1 - (ratio - high)))
    return F.when(file_size == 0, 0.0).when(file_size.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def extraction_characters(text: str) -> Column:
    """A ladder on the share of broken characters; all control characters are counted over the whole text, not its first 10 000."""
    size = F.length(text).cast("double")
    without = lambda p: F.length(F.regexp_replace(text, p, ""))
    share = sum((F.length(text) - without(p) for p in BROKEN), F.lit(0)) / size
    other = (F.length(text) - without(r"\p{C}")) / size
    ladder = F.when((share == 0) & (other < 0.01), 1.0).when(share < 0.001, 0.95).when(share < 0.01, 0.8).when(share < 0.05, 0.5).otherwise(F.greatest(F.lit(0.0), 0.3 - share))
    return F.when(size > 0, ladder).otherwise(0.0)


def extraction_structure(text: str, file_type: Column | None = None) -> Column:
    """Markdown elements against one in 500 to 1000 characters; of plain text, its paragraphs."""
    total, size = sum((count_matches(text, _AS + p) for p in STRUCTURE), F.lit(0)), F.length(text).cast("double")
    few, good = size / 1000, size / 500
    marked = F.when((total == 0) & (size > 500), 0.3).when(total < few, 0.5 + total / few * 0.3).when(total < good, 0.8 + (total - few) / (good - few) * 0.15).otherwise(0.95)
    plain = F.least(F.lit(1.0), 0.5 + count_matches(text, "\n\n+") * 0.05)
    return F.when(size > 0, F.when(_is(file_type, "txt"), plain).otherwise(marked)).otherwise(0.0)


def extraction_images(text: str, file_type: Column | None = None) -> Column:
    """A ladder on references to images, with captions or placeholders in PDF; 1 for plain text."""
    named = _has(text, IMAGES["caption"], "(?imdU)") | _has(text, IMAGES["placeholder"], "(?imdU)")
    some = named | _has(text, IMAGES["markdown"])
    score = F.when(_is(file_type, "txt"), 1.0).when(_is(file_type, "pdf"), F.when(named, 0.9).when(some, 0.7).otherwise(0.5)).when(some, 0.85).otherwise(0.7)
    return F.when(F.length(text) > 0, score).otherwise(0.0)


def extraction_tables(text: str, file_type: Column | None = None) -> Column:
    """0.95 with a Markdown table, 0.7 with a placeholder, else 0.6; 1 for plain text."""
    score = F.when(_is(file_type, "txt"), 1.0).when(_has(text, TABLES["row"]) & _has(text, TABLES["header"]), 0.95).when(_has(text, TABLES["placeholder"]), 0.7).otherwise(0.6)
    return F.when(F.length(text) > 0, score).otherwise(0.0)


def extraction_overall(completeness: Column, characters: Column, structure: Column, images: Column, tables: Column) -> Column:
    """The weighted sum of the five scores, to 4 places."""
    return F.round(sum((w * c for w, c in zip(WEIGHTS.values(), (completeness, characters, structure, images, tables))), F.lit(0.0)), 4)


def word_coverage(source: str, indexed: str) -> Column:
    """The share of the source's distinct words that the indexed text has; 0 for an empty source, 1 if neither has a word."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"(?U)\b\w+\b"), F.lit(0)))
    s, i = words(source), words(indexed)
    none = F.when(F.size(i) == 0, 1.0).otherwise(0.0)
    return F.when(F.coalesce(F.length(source), F.lit(0)) == 0, 0.0).when(F.size(s) == 0, none).otherwise(F.size(F.array_intersect(s, i)) / F.size(s))


def structure_preservation(source: str, indexed: str) -> Column:
    """The mean over the kinds of elements in the source of how many of them the indexed text has, at most all; 1 without any."""
    kinds = (_AS + HEADERS, _AS + LISTS, "\n\n", r"(?d)\[.*?\]\(.*?\)", r"(?d)\*\*.*?\*\*|__.*?__|_.*?_|\*.*?\*")
    parts = F.filter(F.array(*[F.when(count_matches(source, p) > 0, F.least(F.lit(1.0), count_matches(indexed, p) / count_matches(source, p))) for p in kinds]), lambda x: x.isNotNull())
    return F.when(F.size(parts) == 0, 1.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts))


def extraction_confidence(text: str, is_ocr: Column | None = None, ocr_confidence: Column | None = None) -> Column:
    """1, or the recognition's confidence (0.75 where unknown), less 0.02 an error of recognition up to 0.3, then not below 0.3."""
    base = F.when(F.coalesce(is_ocr, F.lit(False)), F.coalesce(ocr_confidence if ocr_confidence is not None else F.lit(None), F.lit(0.75))).otherwise(1.0) if is_ocr is not None else F.lit(1.0)
    errors = sum((count_matches(text, "(?U)" + p) for p in RECOGNITION_ERRORS), F.lit(0))
    return F.when(errors > 0, F.greatest(F.lit(0.3), base - F.least(F.lit(0.3), errors * 0.02))).otherwise(base)


def text_completeness(text: str, expected: Column | None = None, missing: Column | None = None) -> Column:
    """The ladder on the length without outer white space; at most 0.5 or 0.7 under half or 80 % of an expected length, 0.7 with missing sections."""
    size = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)^\s+|\s+$", ""))
    score = F.when(size < 50, 0.3).when(size < 200, 0.6).otherwise(1.0)
    if expected is not None:
        ratio = F.when(expected > 0, size / expected)
        score = F.least(score, F.when(ratio < 0.5, 0.5).when(ratio < 0.8, 0.7).otherwise(1.0))
    return score if missing is None else F.least(score, F.when(missing, 0.7).otherwise(1.0))


def formatting_quality(text: str, structured: Column | None = None, tables: Column | None = None, skipped: Column | None = None) -> Column:
    """0.6 for more than 500 characters without headers, lists and paragraphs, else 1; at most 0.85 with tables; 0.05 less an image left out, up to 0.3, then not below 0.5."""
    bare = ~_has(text, HEADERS) & ~_has(text, LISTS) & ~F.coalesce(F.contains(F.col(text), F.lit("\n\n")), F.lit(False)) & ~(structured if structured is not None else F.lit(False))
    score = F.when(bare & (F.length(text) > 500), 0.6).otherwise(1.0)
    if tables is not None:
        score = F.when(tables, F.least(score, F.lit(0.85))).otherwise(score)
    return score if skipped is None else F.when(skipped > 0, F.greatest(F.lit(0.5), score - F.least(F.lit(0.3), skipped * 0.05))).otherwise(score)
