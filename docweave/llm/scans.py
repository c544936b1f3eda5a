"""Noise in text from scanned pages: running headers, page numbers, words hyphenated across lines, misread characters.

Headers and footers are lines that recur, up to a few characters, at the edges of pages: form feeds part pages, and so do lines that
carry nothing but a number and go on from page to page. Page numbers are such sequences of lines; a number that stands alone is none.
Whether a word that ends a line with a mark is one word or a compound is read from the vocabulary of the whole corpus,
and so are misread words: rare words that become common ones when a known confusion of shapes is undone.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.skew import salted_join
from docweave.session import Scratch

# Shapes that text recognition confuses, as printed and as read.
CONFUSIONS = "nn:mn fl:ll e:c c:e s:5 o:0 i:l l:1 i:1 d:cl u:ii m:rn rn:m h:li g:q b:h h:b in:m w:vv ti:h fi:ii b:6 b:8 g:9 z:2 cl:d li:h"
SHAPES = [tuple(x.split(":")) for x in CONFUSIONS.split()]
#: Digits that stand for letters inside a word.
DIGITS = {"0": "o", "1": "l", "5": "s"}
#: A misread form is at least so many times rarer than the word it stands for.
RARER = 10
SOFT_MARKS = "­‐¬"
MARKS = "-" + SOFT_MARKS

_NUMBER = r"(?:\d{1,5}|(?=[ivxl])x{0,3}(?:ix|iv|v?i{0,3})|l?x{0,3}v?i{0,3})"
_PAGE_LINE = re.compile(rf"[\s\-–—~|\[\]()<>*_.·•]*(?:(?:page|pages|seite|página|pagina|pág|pag|pg|p|s|blatt|folio|fol|hoja)\b[\s.:]*)?(?:n[°º]\s*)?{_NUMBER}(?:\s*(?:/|of|von|de|sur|di|\|)\s*\d{{1,5}})?[\s\-–—~|\[\]()<>*_·•]*", re.I)
_HAS_NUMBER = re.compile(r"\d|^[\W_]*[ivxl]+[\W_]*$", re.I)
_ITEM = re.compile(r"\s*(?:[-•*–·▪‣]\s+[^\W\d]|\d+[.)]\s+[^\W\d])")
_SENTENCE_END = re.compile(r"[.!?…:;,]['\"»)]*\s*$")
_NEW_START = re.compile(r"\s*[^a-zß-öø-ÿ]")
_LETTERS = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"[^\W_]+(?:-[^\W\d_]+)*")
_EDGE_WORDS = {"p", "page", "pages", "seite", "pag", "pág", "pagina", "página", "s", "of", "von", "sur", "blatt"}
_LAST = re.compile(r"([^\W_]+)[" + MARKS + r"]\s*$")
_FIRST = re.compile(r"\s*([^\W_]+)")


def is_page_number(line: str) -> bool:
    """Whether a line carries nothing but what may be a page number."""
    s = line.strip()
    return bool(s) and bool(_HAS_NUMBER.search(s)) and bool(_PAGE_LINE.fullmatch(s))


_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50}


def page_value(line: str) -> int | None:
    """The number of a line that is_page_number(), in digits or Roman."""
    if m := re.search(r"\d+", line):
        return int(m[0])
    m = re.search(r"\b[ivxl]+\b", line.lower())
    if not m:
        return None
    v = [_ROMAN[c] for c in m[0]]
    return sum(-x if y > x else x for x, y in zip(v, [*v[1:], 0]))


def _form(line: str) -> str:
    """How a page number is written: digits and Roman numerals aside."""
    return re.sub(r"\d+|\b[ivxl]+\b", "n", " ".join(line.lower().split()), count=1).split(" of ")[0].split("/")[0].strip()


def number_sequences(lines: list[str], pages: list[int]) -> set[int]:
    """The numbers of the lines that are page numbers: of one form, and each one more than the last for every page between, two at least.

    pages has the page of each line; where form feeds part pages, a number goes up with them, else from line to line.
    """
    runs: dict[str, list[list[tuple[int, int]]]] = defaultdict(list)
    fed = len(set(pages)) > 1
    for k, line in enumerate(lines):
        if is_page_number(line) and (v := page_value(line)) is not None:
            of = runs[_form(line)]
            for run in of:
                at, last = run[-1]
                step = pages[k] - pages[at] if fed else 1
                if v - last == max(step, 1) or (not fed and v - last == 2):
                    run.append((k, v))
                    break
            else:
                of.append([(k, v)])
    out = {k for of in runs.values() for run in of if len(run) > 1 for k, _ in run}
    # Roman numbers of one form that differ need not go up: front matter is bound in any order, and words are no such lines; single
    # letters are left out
    for of in runs.values():
        roman = [(k, v) for run in of for k, v in run if re.search(r"(?i)\b[ivxl]{2,}\b", lines[k]) and not re.search(r"\d", lines[k])]
        if len({v for _, v in roman}) > 1:
            out |= {k for k, _ in roman}
    return out


def _heading_key(line: str) -> str:
    words = _LETTERS.findall(line.lower())
    while words and words[0] in _EDGE_WORDS:
        words = words[1:]
    while words and words[-1] in _EDGE_WORDS:
        words = words[:-1]
    return " ".join(words)


def _alike(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 0.2 * max(len(a), len(b)):
        return False
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    if m.quick_ratio() < 0.88 or m.ratio() < 0.88:
        return False
    # another name in the same sentence is no misreading: words that differ must be alike themselves
    x, y = a.split(), b.split()
    return len(x) != len(y) or all(p == q or difflib.SequenceMatcher(None, p, q, autojunk=False).ratio() >= 0.6 for p, q in zip(x, y))


def page_marks(lines: list[str], pages: list[int] | None = None) -> tuple[set[int], set[int]]:
    """The numbers of the lines that are page numbers, and of those that are running headers or footers.

    A running line recurs, and stands at an edge of a page at least once: of one that form feeds part, beside a page number, at the
    ends of the text, or on one line with a page number.
    """
    pages = pages or [0] * len(lines)
    there = [k for k, x in enumerate(lines) if x.strip()]
    numbers = number_sequences(lines, pages)
    body = [k for k in there if k not in numbers]
    fed = len(set(pages)) > 1
    # the first and last line of each page that is no page number
    edges = {k for i, k in enumerate(body) if i in (0, len(body) - 1) or (fed and (pages[body[i - 1]] != pages[k] or pages[body[i + 1]] != pages[k]))}
    # how many pages have a line of one wording at an edge
    recurs = Counter(key for key, _ in {(_heading_key(lines[k]), pages[k]) for k in edges}) if fed else Counter()
    groups: dict[str, list[tuple[int, bool]]] = defaultdict(list)
    for k in body:
        line = lines[k]
        bare = line.strip().strip("0123456789 \t|–—-[]()/")
        key = _heading_key(line)
        if not key or _ITEM.match(line):
            continue
        known = k in edges and recurs[key] > (2 if _SENTENCE_END.search(bare) else 1)
        if not known:  # what goes on in the next line, or ends a sentence, is text
            nxt = lines[k + 1] if k + 1 < len(lines) else ""
            if len(key) < 4 or _SENTENCE_END.search(bare) or (nxt.strip() and k + 1 not in numbers and not _NEW_START.match(nxt)):
                continue
        beside = bool(re.search(r"^\s*\W*\d+\W*\s{2,}\S|\S\s{2,}\W*\d+\W*$|\bpage\s+\d+|\b[ps]\.\s*\d+", line.rstrip(), re.I))
        groups[key].append((k, k in edges or k - 1 in numbers or k + 1 in numbers or beside))
    # near-equal headings, misread in places, join the group of the most frequent form; only with one that stands at an edge, and
    # compared among lines with a common end
    anchored = {key for key, at in groups.items() if any(anchor for _, anchor in at)}
    keys = sorted(groups, key=lambda x: (-len(groups[x]), x))
    ends: dict[str, list[str]] = defaultdict(list)
    for key in keys:
        for e in {key[:4], "~" + key[-4:]}:
            ends[e].append(key)
    joined: dict[str, str] = {}
    for key in keys:
        if key in joined or key not in anchored:
            continue
        for e in {key[:4], "~" + key[-4:]}:
            for other in ends[e]:
                if other != key and other not in joined and len(groups[other]) <= len(groups[key]) and _alike(key, other):
                    joined[other] = key
    for other, key in joined.items():
        while key in joined:
            key = joined[key]
        groups[key] += groups[other]
    headers: set[int] = set()
    for key, at in groups.items():
        # with form feeds it must be on several pages, else at several places
        if key not in joined and len({pages[k] if fed else k for k, _ in at}) > 1 and any(anchor for _, anchor in at):
            headers |= {k for k, _ in at}
    return numbers, headers


def broken_words(lines: list[str], skip: set[int]) -> list[tuple[int, int, str, str, str]]:
    """(line, next text line, first part, mark, second part) of words that end a line with a mark."""
    body = [k for k, x in enumerate(lines) if x.strip() and k not in skip]
    out = []
    for k, n in zip(body, body[1:]):
        line = lines[k].rstrip()
        if line and line[-1] in MARKS and (a := _LAST.search(line)) and (b := _FIRST.match(lines[n])):
            first, second = a[1], b[1]
            if first[-1].isalpha() and second[0].isalpha() and (line[-1] != "-" or second[0].islower()):
                out.append((k, n, first, line[-1], second))
    return out


class Page:
    """A text taken apart; texts on one line have no pages and no noise."""

    def __init__(self, text: str | None):
        parts = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\f")
        self.lines, self.pages = [], []
        for number, part in enumerate(parts):
            here = part.split("\n")
            self.lines += here
            self.pages += [number] * len(here)
        self.scanned = len(self.lines) > 1
        self.numbers, self.headers = page_marks(self.lines, self.pages) if self.scanned else (set(), set())
        self.breaks = broken_words(self.lines, self.numbers | self.headers) if self.scanned else []

    def words(self) -> Counter[str]:
        """Words in lower case, compounds whole, and how often; the parts of broken words are left out."""
        last = {k for k, *_ in self.breaks}
        first = {n for _, n, *_ in self.breaks}
        whole = "\n".join(x for k, x in enumerate(self.lines) if k not in first and k not in last)
        out = Counter(_WORD.findall(whole.lower()))
        for k in first | last:
            found = _WORD.findall(self.lines[k].lower())
            out.update(found[k in first : len(found) - (k in last)])
        return out


def corrections_of(word: str) -> set[str]:
    """What a word may have been: one confusion undone at one place or at all its places, or two of them."""
    out: set[str] = set()
    for printed, read in SHAPES:
        at = word.find(read)
        if at >= 0:
            out.add(word.replace(read, printed))
        while at >= 0:
            out.add(word[:at] + printed + word[at + len(read) :])
            at = word.find(read, at + 1)
    for one in list(out) if any(c in DIGITS for c in word) else []:
        for digit, letter in DIGITS.items():
            out.add(one.replace(digit, letter))
    return out - {word}


def mixes_digits(word: str) -> bool:
    """Letters with single digits among them that look like letters, as no code or number has them."""
    inside = [c for c in word if c.isdigit()]
    return 0 < len(inside) <= 2 and all(c in DIGITS for c in inside) and sum(c.isalpha() for c in word) >= 4 and word[0].isalpha() | word[1].isalpha() and not re.search(r"\d\d|[a-z]\d$", word.replace("5", "") if word.endswith("5") else word)


TAKEN = "scanned boolean, page_number boolean, header boolean, breaks array<struct<first:string,mark:string,second:string>>, words array<string>, word string, n bigint, tag string"


class ScanNoise:
    """rows (key, text): the noise in every text, and the repaired texts.

    Null, blank and one-line texts have no noise; rows of one key count as one, with the noise of them all, and are repaired as
    the smallest of their texts. The vocabulary is counted over all rows. An empty table gives no rows. Every text is taken
    apart once; what it shows and its words are written, and all else is made from that.
    """

    def __init__(self, rows: DataFrame, key: str, text: str, scratch: Scratch | None = None):
        self.spark, self.key = rows.sparkSession, key
        self.scratch = scratch or Scratch(self.spark, "scans")
        self.rows = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
        taken = self.scratch.write("taken", self._taken(), ["tag"])
        self.marks = taken.where("tag = 'text'")
        counted = taken.where("tag = 'word'").groupBy("word").agg(F.sum("n").alias("n"))
        self.vocabulary = self.scratch.write("vocabulary", counted)
        self.misread = self.scratch.write("misread", self._misread())
        self.wrong, self.joined = self._verdicts()

    def _taken(self) -> DataFrame:
        """One pass over the texts: rows of tag text say what each text of several lines shows by itself (noise at its pages' edges, words broken
        at line ends, its words), rows of tag word how often words stand in all texts, compounds whole and in parts."""
        kind = self.rows.schema["key"].dataType.simpleString()
        part = pa.struct([("first", pa.string()), ("mark", pa.string()), ("second", pa.string())])
        types = [pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(part), pa.list_(pa.string()), pa.string(), pa.int64(), pa.string()]
        names = ["key", "scanned", "page_number", "header", "breaks", "words", "word", "n", "tag"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, out = [], []
                counts: Counter[str] = Counter()
                for i, t in enumerate(b.column(1).to_pylist()):
                    p = Page(t)
                    c = p.words()
                    counts.update(c)
                    if "-" in t:
                        counts.update(w for x in _WORD.findall(t.lower()) if "-" in x for w in x.split("-"))
                    if p.scanned:
                        broken = [{"first": x.lower(), "mark": m, "second": y.lower()} for _, _, x, m, y in p.breaks]
                        at.append(i)
                        out.append((True, bool(p.numbers), bool(p.headers), broken, list(c), None, None, "text"))
                columns = list(zip(*out)) if out else [()] * 8
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, types))], names=names)
                if counts:
                    size = len(counts)
                    none = [pa.nulls(size, k) for k in (b.column(0).type, *types[:5])]
                    yield pa.RecordBatch.from_arrays([*none, pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array(["word"] * size)], names=names)

        return self.rows.where("text IS NOT NULL").mapInArrow(run, f"key {kind}, {TAKEN}")

    def _misread(self) -> DataFrame:
        """(word, stands_for): the misread words of the vocabulary."""

        def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if len(w) >= 3 and any(c.isalpha() for c in w) and not w.isdigit():
                        out += [(w, n, c) for c in corrections_of(w)]
                        if mixes_digits(w):
                            plain = w
                            for digit, letter in DIGITS.items():
                                plain = plain.replace(digit, letter)
                            out.append((w, -1, plain))  # misread in any case
                w, n, c = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64()), pa.array(c, pa.string())], names=["word", "n", "guess"])

        guesses = self.vocabulary.mapInArrow(guess, "word string, n bigint, guess string")
        known = self.vocabulary.select(F.col("word").alias("guess"), F.col("n").alias("common"))
        seen = guesses.join(known, "guess", "left").where((F.col("n") < 0) | (F.col("common") >= F.greatest(F.col("n") * RARER, F.lit(RARER / 2))))
        best = F.max_by("guess", F.struct(F.coalesce("common", F.lit(0)), "guess"))
        return seen.groupBy("word").agg(best.alias("stands_for"))

    def _verdicts(self) -> tuple[DataFrame, DataFrame]:
        """(key, word, stands_for) of misread words, and (key, first, mark, second, whole) of broken words to join."""
        lined = self.marks
        whole = F.transform("breaks", lambda x: F.concat(x["first"], x["second"]))
        suspects = lined.select("key", F.explode(F.array_union("words", whole)).alias("word"))
        # misread words are rare ones, so no word is hot on this side of the join
        wrong = suspects.join(self.misread, "word")
        breaks = self.marks.select("key", F.explode("breaks").alias("b")).select("key", "b.*")
        cases = breaks.select("first", "mark", "second").distinct()
        for name, word in (("n_whole", F.concat("first", "second")), ("n_compound", F.concat("first", F.lit("-"), "second"))):
            known = self.vocabulary.select(F.col("word").alias("__w"), F.col("n").alias(name))
            cases = cases.withColumn("__w", word).join(known, "__w", "left").drop("__w")
        compound = (F.col("mark") == "-") & F.col("n_compound").isNotNull() & (F.coalesce("n_whole", F.lit(0)) < F.col("n_compound"))
        verdict = cases.where(~F.coalesce(compound, F.lit(False))).select(F.concat_ws("\t", "first", "mark", "second").alias("broken"))
        breaks = breaks.withColumn("broken", F.concat_ws("\t", "first", "mark", "second"))
        joined = salted_join(breaks, verdict, "broken", "inner", F.col("key"))
        return wrong.select("key", "word", "stands_for"), joined.select("key", "broken")

    def found(self) -> DataFrame:
        """(key, noise): one row for each kind of noise in a text."""
        kinds = (
            (self.joined.select("key").distinct(), "hyphenation"),
            (self.wrong.select("key").distinct(), "misread"),
            (self.marks.where("header").select("key"), "header"),
            (self.marks.where("page_number").select("key"), "page_number"),
        )
        out = None
        for keys, noise in kinds:
            one = keys.select(F.col("key").alias(self.key), F.lit(noise).alias("noise"))
            out = one if out is None else out.unionByName(one)
        return out.distinct()

    def repaired(self) -> DataFrame:
        """(key, text): paragraphs without headers and page numbers, words whole and misread ones put right.

        Every key comes out once; texts on one line and null texts as they are.
        """
        words = self.wrong.groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("word", "stands_for"))).alias("words"))
        whole = self.joined.groupBy("key").agg(F.collect_set("broken").alias("whole"))
        texts = self.rows.groupBy("key").agg(F.min("text").alias("text"))
        full = texts.join(words, "key", "left").join(whole, "key", "left").select("key", "text", "words", "whole")
        kind = self.rows.schema["key"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [repair(t, dict(w or ()), set(j or ())) for t, w, j in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["key", "text"])

        return full.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", self.key)


def _like(old: str, new: str) -> str:
    """new in the case of old."""
    letters = [c for c in old if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return new.upper()
    return new[:1].upper() + new[1:] if letters and letters[0].isupper() else new


def repair(text: str | None, words: dict[str, str], whole: set[str]) -> str | None:
    """One text repaired: words maps misread words, whole has the broken words that are one, their parts and mark joined by tabs."""
    if text is None:
        return None
    page = Page(text)
    if not page.scanned:
        return text
    gone = page.numbers | page.headers
    lines = list(page.lines)
    merged: set[int] = set()
    for k, n, first, mark, second in page.breaks:
        end = lines[k].rstrip()
        rest = lines[n].lstrip()
        if f"{first}\t{mark}\t{second}".lower() in whole:
            end = end[:-1]
        lines[k] = end + rest[: len(second)]
        lines[n] = rest[len(second) :].lstrip(" ") if rest[len(second) :].startswith(" ") else rest[len(second) :]
        if lines[n] and not lines[n][0].isspace() and not lines[n][0].isalnum():
            lines[k] += lines[n][:1]  # the sign after the word stays with it
            lines[n] = lines[n][1:].lstrip()
        merged.add(n)
    body: list[str] = []
    blank = True
    for k, line in enumerate(lines):
        s = " ".join(line.split())
        if k in gone:
            continue  # what stood around it runs on
        if not s:
            blank = blank or (k not in merged and bool(page.lines[k].strip() == "") and not _open(body))
            continue
        if body and not blank and not _ITEM.match(line) and not _ITEM.match(body[-1]):
            body[-1] += " " + s
        elif body and blank and _open(body) and s[:1].islower():
            body[-1] += " " + s  # a paragraph goes on over the page
        else:
            body.append(s)
        blank = False
    out = "\n\n".join(body)
    if words:
        out = re.sub(r"[^\W_]+", lambda m: _like(m[0], words[m[0].lower()]) if m[0].lower() in words else m[0], out)
    return out


def _open(body: list[str]) -> bool:
    """Whether the last paragraph has not come to the end of a sentence."""
    return bool(body) and not _SENTENCE_END.search(body[-1])
