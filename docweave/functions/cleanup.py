"""Normalisation of extracted text by source type and settings, with the list of what was changed.

One Arrow pass does all steps of a text. Words are judged by a word list that is passed in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import normalise

RESULT = "struct<text:string,changes_made:array<string>,original_length:bigint,normalised_length:bigint>"
FLAGS = "enabled fix_spaced_letters fix_word_boundaries fix_line_breaks fix_ocr_spelling fix_ligature_errors fix_title_ocr remove_captions remove_boilerplate remove_zero_width_chars".split()
CONSERVATIVE, MODERATE, AGGRESSIVE = "conservative", "moderate", "aggressive"

# Lines of web pages that are no content, by kind. A line is of a kind if it begins so; $ marks where it must end too.
NAVIGATION = r"""(home|about|contact|privacy|terms|sitemap|search|menu|navigation)\s*$
\s*[|>»›→]\s*(home|about|contact|privacy|terms)\s*$
(skip|jump|go) to\s+(main|content|navigation)
(previous|next|back|forward)\s*(page|article)?$
page\s+\d+\s*(of\s+\d+)?$
(first|last|prev|next)\s*$"""
FOOTER = r"""©\s*\d{4}
copyright\s*©?\s*\d{4}
all rights reserved\.?$
(privacy policy|terms of (service|use)|cookie policy)$
((contact|about) us|careers|press|investors)$
(follow us|connect with us|stay connected)$
(subscribe|newsletter|sign up|register)$
powered by\s+\w+
(facebook|twitter|linkedin|instagram|youtube)\s*$"""
COOKIES = r"""(this (site|website) uses|we use|(accept|reject) (all )?) ?cookies
cookie (policy|notice|preferences|settings)
manage (cookie )?preferences
by (continuing|using|browsing)
gdpr|ccpa|privacy"""
ADVERTISEMENT = r"""advertisement$
sponsored\s*(content|post|link)?$
promoted\s*(content|post)?$
(click here|(learn|read|see) more)$
(buy|shop|order|subscribe) now$
free (trial|shipping|download)$
(limited time|special offer|sale|discount)$"""
SOCIAL = r"""(share|tweet|pin|post)\s*(this|on)?$
share (on|via)\s+(facebook|twitter|linkedin)
(like|follow|subscribe)\s*(us)?$
\d+\s*(likes?|shares?|comments?|views?)$
(print|email|save)\s*(this)?\s*(article|page)?$"""
COMMENTS = r"""(leave|post|add|write)\s+a?\s*comment
\d+\s*comments?$
(reply|respond)\s*(to\s+this)?$
(log ?in|sign ?in)\s+to\s+(comment|reply)
comments?\s+(are\s+)?(closed|disabled)"""
RELATED = r"""(related|similar|recommended)\s*(articles?|posts?|content)?$
(you (may|might) also like|also read|see also)$
(popular|trending|featured)\s*(articles?|posts?)?$
(more from|other articles by)$
in this (section|category)$"""
KINDS = {"navigation": NAVIGATION, "footer": FOOTER, "cookie_notice": COOKIES, "advertisement": ADVERTISEMENT, "social": SOCIAL, "comments": COMMENTS, "related": RELATED}
MODES = {CONSERVATIVE: ("navigation", "footer", "cookie_notice"), MODERATE: ("navigation", "footer", "cookie_notice", "social", "advertisement"), AGGRESSIVE: tuple(KINDS)}
# Such lines of single sites.
SITES = {
    "medium.com": r"(Sign in|Sign up|Get started|Open in app|Follow|Clap|Share|Save)\s*$|\d+\s*min\s+read$|(Written by|Read more from|Published in|More from) .+$|Member-only story$|Responses \(\d+\)$|Listen$|Share your thinking\.$",
    "nytimes.com": r"(Advertisement|Supported by|SKIP ADVERTISEMENT|Continue reading the main story|More in .+|Editors' Picks|Site Index|The Times)$",
    "linkedin.com": r"(Like|Comment|Share|Repost)\s*$|\d+\s*(reactions?|comments?)$|(Send|Copy link|Report this post|Messaging|LinkedIn)$",
    "twitter.com": r"(Retweet|Quote Tweet|Bookmark)$|\d+\s*(Retweets?|Likes?|Replies)$",
    "substack.com": r"(Subscribe|Share|Upgrade to paid|Leave a comment)$|\d+\s*(likes?|comments?)$",
}
# What opens and closes a block that is left out.
BLOCK_START = re.compile(r"([-=#])\1{2,}\s*(footer|header|sidebar|nav(igation)?)\s*\1{3,}$", re.I)
BLOCK_END = re.compile(r"([-=])\1{2,}\s*end\s*\1{3,}$|\[end\s*\w*\]$|end\s+(footer|header|sidebar|nav(igation)?)$|-{3,}\s*(content|main|article)\s*-{3,}$", re.I)
# Lines that are captions.
CAPTION = re.compile(r"(?:Figure|Fig\.|Table|Chart|Graph|Exhibit|Diagram)\s*\d+[.:\-]\s*.+$|(?:Photo(?: credit)?|Image(?: description)?|Credit|Illustration(?: by)?|Photograph(?: by)?|Picture|Video|Watch|Listen):\s*.+$|\[(?:Image|Photo|Figure):.*\]$|\((?:Image|Photo|Courtesy of .+)\)$|Courtesy of .+$", re.I)
# Frequent words as text recognition misreads them, misread and right.
MISSPELT = "tbe:the tlie:the wbich:which wbat:what tbat:that tbis:this witb:with frorn:from sorne:some tirne:time rnore:more becorne:become narne:name sarne:same carne:came garne:game frarne:frame"
TITLES = "Ati:An Tlie:The Tbe:The Wliat:What Wlien:When Wliere:Where Wliich:Which Wliy:Why Tliis:This Tliat:That Tliese:These Tliose:Those"
SHAPES = {"rn": "m", "vv": "w", "cl": "d", "ii": "u", "nn": "m"}
LIGATURE_STARTS = "deii:defi iind:find iirst:first iive:five iinal:final iire:fire iish:fish ofii:offi suii:suffi afii:affi efii:effi ilow:flow ioor:floor ilee:flee iag:flag"

_ANY = {kind: re.compile("(?:" + "|".join(f"(?:{x})" for x in text.split("\n")) + ")", re.I) for kind, text in KINDS.items()}
_RULE = re.compile(r"[\s\-_=|•·→›»<>]+$")
_ALONE = re.compile(r"https?://\S+$|\S+@\S+\.\S+$")


def _pairs(text: str) -> dict[str, str]:
    return dict(x.split(":") for x in text.split())


def _cased(old: str, new: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new


def fix_spelling(text: str, words: set[str]) -> str:
    """Frequent words as recognition misreads them, and unknown words that one confusion of shapes makes known."""
    known = _pairs(MISSPELT)

    def fix(m: re.Match) -> str:
        w = m[0]
        low = w.lower()
        if low in known:
            return _cased(w, known[low])
        if len(w) < 4 or low in words:
            return w
        for read, meant in SHAPES.items():  # at all places, or at one
            for right in (low.replace(read, meant), *(low[: p.start()] + meant + low[p.end() :] for p in re.finditer(read, low))):
                if right != low and right in words:
                    return _cased(w, right)
        return w

    return re.sub(r"[^\W\d_]+", fix, text)


def fix_titles(text: str) -> str:
    """The opening words of headings as recognition misreads them."""
    text = re.sub(r"\bQii", "Qu", text)
    return re.sub(r"\b(?:" + "|".join(_pairs(TITLES)) + r")\b", lambda m: _pairs(TITLES)[m[0]], text)


def fix_ligatures(text: str, words: set[str]) -> str:
    """Ligature signs as letters, and ii or i that stands for fi or fl, where the word is not known as it is."""
    text = normalise.expand_ligatures(text)
    starts = _pairs(LIGATURE_STARTS)

    def fix(m: re.Match) -> str:
        w = m[0]
        low = w.lower()
        if low in words:
            return w
        for read, meant in starts.items():
            if low.startswith(read):
                return _cased(w, meant + low[len(read) :])
        return _cased(w, re.sub(r"(?<=[a-z])ii(?=[a-z])|^ii(?=[aeiou])", "fi", low)) if "ii" in low else w

    return re.sub(r"[^\W\d_]+", fix, text)


def remove_captions(text: str) -> str:
    return "\n".join(x for x in text.split("\n") if not CAPTION.match(x.strip()))


def is_boilerplate(line: str, mode: str = MODERATE, extra: re.Pattern | None = None) -> bool:
    """Whether a line that is not blank is none of the content."""
    s = line.strip()
    if any(_ANY[kind].match(s) for kind in MODES.get(mode, ())) or (extra is not None and extra.match(s)):
        return True
    if (len(s) < 5 and not any(c.isalpha() for c in s)) or _RULE.match(s):
        return True
    if mode != AGGRESSIVE:
        return False
    parts = s.split()
    shouting = len(parts) <= 4 and all(p[0].isupper() for p in parts) and sum(c.isupper() for c in s) > 0.5 * len(s)
    return shouting or bool(_ALONE.match(s))


def remove_boilerplate(text: str, mode: str = MODERATE, domain: str | None = None, custom: list[str] = ()) -> str:
    """The lines that are content; mode widens the kinds left out, a known site and custom patterns add theirs. Marked blocks go whole."""
    patterns = [SITES[s] for s in SITES if domain and (domain == s or domain.endswith(f".{s}"))] + list(custom)
    extra = re.compile("|".join(f"(?:{p})" for p in patterns)) if patterns else None
    out, skipping = [], False
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            out.append(line)
        elif BLOCK_START.match(s):
            skipping = True
        elif skipping:
            skipping = not BLOCK_END.match(s)
        elif not is_boilerplate(line, mode, extra):
            out.append(line)
    return "\n".join(out)


def block_label(text: str) -> str:
    """navigation, footer, cookie_notice, advertisement, social, comments, related, short_text, content, header, boilerplate or uncertain."""
    for kind, pattern in _ANY.items():
        if pattern.search(text) if kind == "cookie_notice" else pattern.match(text):
            return kind
    if len(text) < 20:
        return "short_text"
    words = len(text.split())
    if words >= 20 and len(re.findall("[.!?]", text)) >= 2:
        return "content"
    return ("header" if text[0].isupper() else "boilerplate") if words < 10 else "uncertain"


def content_blocks(text: str) -> list[dict]:
    """The paragraphs of a text with their label and place: (type, start, stop, length)."""
    out, at = [], 0
    for m in re.finditer(r"\n\s*\n|$", text):
        part = text[at : m.start()]
        if part.strip():
            begin = at + len(part) - len(part.lstrip())
            out.append({"type": block_label(part.strip()), "start": begin, "stop": begin + len(part.strip()), "length": len(part.strip())})
        at = m.end()
    return out


def normalised(text: str | None, source_type: str | None, settings: dict, words: set[str]) -> dict | None:
    """text, changes_made, original_length and normalised_length; null for null. A disabled setting leaves the text as it is."""
    if text is None:
        return None
    changes: list[str] = []
    out = text

    def step(name: str, flag: str | None, new) -> None:
        nonlocal out
        if flag is None or settings.get(flag, True):
            fresh = new(out)
            if fresh != out:
                changes.append(name)
                out = fresh

    if settings.get("enabled", True):
        if source_type == "pdf":
            step("fixed_spaced_letters", "fix_spaced_letters", lambda t: normalise.join_spaced_letters(t, words))
            step("fixed_word_boundaries", "fix_word_boundaries", lambda t: normalise.split_joined_words(t, words))
            step("fixed_spurious_newlines", "fix_line_breaks", normalise.join_broken_lines)
            step("fixed_ligature_errors", "fix_ligature_errors", lambda t: fix_ligatures(t, words))
            step("fixed_title_ocr", "fix_title_ocr", fix_titles)
            step("fixed_ocr_spelling", "fix_ocr_spelling", lambda t: fix_spelling(t, words))
            step("removed_captions", "remove_captions", remove_captions)
        elif source_type == "html":
            mode = settings.get("boilerplate_mode") or AGGRESSIVE
            step("fixed_html_line_breaks", "fix_line_breaks", lambda t: re.sub(r"(\w)-\n(\w)", r"\1\2", re.sub(r"([a-z,;:])\n([a-z])", r"\1 \2", t)))
            step(f"removed_boilerplate_{mode}", "remove_boilerplate", lambda t: remove_boilerplate(t, mode))
            step("removed_captions", "remove_captions", remove_captions)
        step("removed_zero_width_chars", "remove_zero_width_chars", lambda t: re.sub("[​-‍⁠﻿]", "", t))
        step("normalised_whitespace", None, lambda t: re.sub(r"[^\S\n]+", " ", t))
        step("stripped_line_whitespace", None, lambda t: "\n".join(x.strip() for x in t.split("\n")))
        step("collapsed_blank_lines", None, lambda t: re.sub(r"\n{3,}", "\n\n", t))
        out = out.strip()
    return {"text": out, "changes_made": changes, "original_length": len(text), "normalised_length": len(out)}


def normalise_rows(rows: DataFrame, settings: DataFrame, words: set[str], text: str = "text", source_type: str = "source_type", settings_id: str = "settings_id", default: int = 1) -> DataFrame:
    """rows with a column normalised: every text by the settings its row names, those of default where it names none or unknown ones.

    settings is a table of one row an id, at most 1000 (an error beyond); a null flag counts as true. Null texts stay null, null
    source types take the steps that all types have. words is sent to every worker once: pass a list of bounded size.
    """
    listed = settings.dropDuplicates(["settings_id"]).limit(1001).collect()
    if len(listed) > 1000:
        raise ValueError("more than 1000 settings")
    known = {r["settings_id"]: {k: v for k, v in r.asDict().items() if v is not None} for r in listed}
    shared = rows.sparkSession.sparkContext.broadcast((known, words))

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table, vocabulary = shared.value
        for t, kind, which in batches:
            done = [normalised(a, b, table.get(int(c) if pd.notna(c) else default, table.get(default, {})), vocabulary) or {} for a, b, c in zip(t, kind, which)]
            yield pd.DataFrame({k: pd.Series([d.get(k) for d in done], dtype="object") for k in ("text", "changes_made", "original_length", "normalised_length")})

    made = run(F.col(text), F.lower(F.btrim(F.col(source_type))), F.col(settings_id))
    return rows.withColumn("normalised", F.when(F.col(text).isNotNull(), made))


def blocks_column(text: str | Column) -> Column:
    """content_blocks() as a column; null for null."""

    @F.pandas_udf("array<struct<type:string,start:int,stop:int,length:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else content_blocks(t) for t in s], dtype="object")

    return run(F.col(text) if isinstance(text, str) else text)


def boilerplate_column(text: str | Column, mode: str = MODERATE, custom: list[str] = ()) -> Column:
    """remove_boilerplate() as a column; null for null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else remove_boilerplate(t, mode, None, list(custom)) for t in s], dtype="object")

    return run(F.col(text) if isinstance(text, str) else text)
