"""Texts cut off by field limits or in transfer.

Two kinds of evidence meet. Lengths: the lengths of each source are fitted by a log-normal distribution, by maximum likelihood
with those at a candidate limit counted as right-censored; where many more texts than the fit expects have exactly one length,
most of them were cut there, which gives every text at that length a posterior of being censored. Endings: what the form of the
last line leaves open is settled by likelihoods from the corpus, of its opening among titles against sentences, and of its last word
among the ends of whole lines against words anywhere, where a cut falls. The odds of both kinds are multiplied.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.keys import norm_key
from docweave.session import Scratch

# Phrases before dots that close an open list.
AND_SO_ON = ("and so on", "and so forth", "etc", "etcétera", "et ainsi de suite", "und so weiter", "usw", "y así sucesivamente", "entre otros")
# Words after which a number with a point goes on (a version, a clause, a German date).
NUMBER_GOES_ON = "version versión versione clause section sección abschnitt above article artículo artikel absatz § am und zwischen vom bis dem des"

_SENTENCE = re.compile(r"[.!?。！？]['\"”’»)\]]*$")
_INNER = re.compile(r"[.!?。！？]['\"”’»)\]]*\s+\S")
_DOTS = re.compile(r"(?:…|\.{3,})$")
_CUT_SIGN = re.compile(r"(?:\[\s*(?:…|\.{3,})\s*\]|\(\s*(?:…|\.{3,})\s*\)|[(\[{,;–—\-/&+=<]|[:]|\b(?:\[truncated\]|\(more\)))$", re.I)
_ITEM = re.compile(r"\s*(?:[-•*–·▪‣]|\d+[.)]|[a-z]\))\s+(?=\S)")
_TABLE = re.compile(r"\s*\|")
_CODE = re.compile(r"(?: {4}|\t)\s*\S")
_REFERENCE = re.compile(r"\s*\[\d+\]\s+\S")
_YEAR_END = re.compile(r"\b(?:1[5-9]|20)\d\d[a-z]?\)?$")
_PATH = re.compile(r"\s*(?:[a-zA-Z]:)?(?:[\\/][^\s\\/]+){2,}$|\s*https?://\S+$")
_EXTENSION = re.compile(r"\.\w{1,5}$")
_LABEL = re.compile(r"\s*[^\W\d_][\w .-]{0,24}:\s+\S")
_TOKEN = re.compile(r"\w+(?:[-'’]\w+)*")
_GOES_ON = re.compile(r"(?:^|\s)(" + "|".join(re.escape(x) for x in NUMBER_GOES_ON.split()) + r")\s+\d{1,2}\.$", re.I)

#: What each kind of ending says by itself: complete, cut, or open (to be read from the corpus' words).
COMPLETE, CUT, OPEN = "complete", "cut", "open"
#: Cuts for each complete text, before words and lengths are looked at: of texts that end in a whole code line, row, reference or path; in a
#: list item, label or short line; in a line of its own.
WHOLE_LINE_ODDS, LINE_ODDS, LONE_ODDS = 1 / 30, 1 / 5, 1.0
#: Ends a word is granted over those seen and expected, so that rare words say little.
GRANTED = 1.0
#: The share of cuts that leave a piece of a word which stands nowhere else than at ends of texts.
PIECES = 0.5
#: The share of whole lines whose last word, written large, stands nowhere else and begins a longer word of the corpus.
PIECE_BY_CHANCE = 1 / 50
#: A length is examined as a limit if its texts number so many deviations (Poisson) above what is expected, by the fit and by the lengths at most NEAR away.
DEVIATIONS, NEAR = 6, 25
LONE, LINE = "lone", "line"


def stripped(text: str) -> tuple[str, bool]:
    """A text without the blanks and signs (not punctuation) at its end, and whether a broken character was among them."""
    end, broken = len(text), False
    while end and (text[end - 1].isspace() or unicodedata.category(text[end - 1]) in ("Cf", "Cc", "Cn", "Co", "Cs", "So", "Mn", "Sk")):
        if unicodedata.category(text[end - 1]) == "Mn" and end > 1 and text[end - 2].isalpha():
            break
        broken |= text[end - 1] == "�"
        end -= 1
    return text[:end], broken


def _token(word: str) -> str:
    if any(c.isdigit() for c in word):
        return "9"
    return "X" if word[:1].isupper() else word.lower()


def opening(line: str) -> tuple[str, str, str]:
    """How a line begins: its first word, its first two with names and numbers as classes, and the two with any first word."""
    words = _TOKEN.findall(line)[:2]
    first = "9" if words and any(c.isdigit() for c in words[0]) else words[0].lower() if words else ""
    if len(words) < 2:
        return first, first, "*"
    colon = ":" if re.match(rf"\s*{re.escape(words[0])}\s*:", line) else ""
    return first, f"{first}{colon} {_token(words[1])}", f"*{colon} {_token(words[1])}"


def _last_word(line: str) -> str:
    words = _TOKEN.findall(line)
    return words[-1] if words else ""


def _balanced(line: str) -> bool:
    return all(line.count(a) == line.count(b) for a, b in ("()", "[]", "{}")) and line.count("'") % 2 == 0 and line.count('"') % 2 == 0


def ending(text: str) -> tuple[str, str, str]:
    """(verdict, kind, line) of how a text ends; an open verdict names the line whose words decide."""
    body, broken = stripped(text)
    if not body:
        return COMPLETE, "blank", ""
    if broken:
        return CUT, "broken character", ""
    lines = body.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    line = lines[-1]
    before = next((x for x in reversed(lines[:-1]) if x.strip()), "")
    new_paragraph = len(lines) < 2 or not lines[-2].strip()
    if _DOTS.search(body):
        rest = _DOTS.sub("", body).rstrip().lower()
        return (COMPLETE, "and so on", "") if rest.endswith(AND_SO_ON) else (CUT, "dots", "")
    if _CODE.match(line) and not _ITEM.match(line):
        whole = _balanced(line) and re.search(r"(?:[=<>]\s*\S+|[)\]}:;'\"]|\b(?:pass|return|break|continue|else|try))$", line)
        return (OPEN, "code", "") if whole else (CUT, "code", "")
    if _TABLE.match(line):
        cells = line.count("|")
        whole = line.endswith("|") and (not _TABLE.match(before) or not before.rstrip().endswith("|") or before.count("|") == cells)
        return (OPEN, "table", "") if whole else (CUT, "table", "")
    if _CUT_SIGN.search(body):
        return CUT, "sign", ""
    if _SENTENCE.search(body):
        return (CUT, "number", "") if _GOES_ON.search(body[-40:]) else (COMPLETE, "sentence", "")
    if _REFERENCE.match(line):
        return (OPEN, "reference", "") if _YEAR_END.search(line) else (CUT, "reference", "")
    if _PATH.fullmatch(line):
        return (OPEN, "path", "") if _EXTENSION.search(line) else (CUT, "path", "")
    if _INNER.search(line):
        return CUT, "prose", ""
    if _ITEM.match(line):
        return OPEN, LINE, _ITEM.sub("", line, count=1)
    if _LABEL.match(line) and len(line) < 60 and len(_TOKEN.findall(line)) <= 6:
        return OPEN, LINE, line
    if new_paragraph:
        return OPEN, LONE, line
    short = len(before) <= 40 and not re.search(r"[.!?:;,]\s*$|\d", before) and len(line) <= 60
    return (OPEN, LINE, line) if short else (CUT, "prose", "")


def last_class(word: str) -> str:
    """The last word of a line as it is counted: a number, a name, or the word."""
    return _token(word) if word else ""


def _observe(text: str) -> Iterator[tuple[str, str]]:
    """What a text tells of titles, sentences and the ends of whole lines; its own end is left out.

    A line is whole if a blank line, an item or a row follows; lines that are merely wrapped are not. Ends of sentences do not count,
    as a line that ends so is complete anyway.
    """
    body = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = body.split("\n")
    for i, line in enumerate(lines[:-1]):
        s = line.strip()
        if not s or _SENTENCE.search(s):
            continue
        after = lines[i + 1]
        if not after.strip() or _ITEM.match(after) or _TABLE.match(after):
            yield "end", last_class(_last_word(s))
        if i == 0 and not after.strip() and not _ITEM.match(s):
            for k in opening(s):
                yield "title", k
    starts = re.split(r"(?<=[.!?])\s+", body)
    for i, s in enumerate(starts[:-1]):
        if i or "\n" not in s.strip():
            last = s.rsplit("\n", 1)[-1]
            for k in opening(last if "\n" in s else s):
                yield "sentence", k


def _censored_fit(n: np.ndarray, total: np.ndarray, squares: np.ndarray, censored: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of log lengths: n seen ones with these sums, and censored ones known to be above limit (by EM)."""
    erf = np.vectorize(math.erf)
    count = np.maximum(n, 1)
    mu = np.where(n > 0, total / count, np.log(np.maximum(limit, 1)))
    sigma = np.sqrt(np.maximum(np.where(n > 1, squares / count - mu**2, 0.25), 0.01))
    c = np.log(np.maximum(limit, 1))
    for _ in range(60):
        z = (c - mu) / sigma
        tail = np.maximum(0.5 * (1 - erf(z / math.sqrt(2))), 1e-12)
        ratio = np.exp(-0.5 * z**2) / math.sqrt(2 * math.pi) / tail
        mean = mu + sigma * ratio
        square = mu**2 + sigma**2 + sigma * ratio * (c + mu)
        whole = np.maximum(n + censored, 1)
        new = (total + censored * mean) / whole
        sigma = np.sqrt(np.maximum((squares + censored * square) / whole - new**2, 0.01))
        mu = new
    return mu, sigma


class Truncation:
    """documents (key, source, text): which texts were cut off, and how often each source does it.

    Source labels compare trimmed and in lower case, null and blank ones are one source. Null, empty and blank texts are
    complete. A key delivered twice counts once, with its longest text. Every row is read whole; an empty table gives no rows.
    """

    def __init__(self, documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", scratch: Scratch | None = None):
        self.key = key
        self.scratch = scratch or Scratch(documents.sparkSession, "truncation")
        self.rows = documents.select(F.col(key).alias("key"), F.coalesce(norm_key(source), F.lit("")).alias("source"), F.col(text).alias("text"))
        self.taken = self.scratch.write("taken", self._taken(), ["tag"])
        self.ends = self.scratch.write("ends", self._ends())
        self.limits = self.scratch.write("limits", self._limits())

    def _taken(self) -> DataFrame:
        """One pass over the texts: rows of tag end say how each of them ends, rows of tag word how often words open, end and stand in lines."""
        kind = self.rows.schema["key"].dataType.simpleString()
        ends = ["verdict", "kind", "last", "first", "two", "any_two"]
        names = ["key", "source", *ends, "alone", "size", "what", "word", "n", "tag"]
        types = [*[pa.string()] * 6, pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                counts: Counter[tuple[str, str]] = Counter()
                words: Counter[str] = Counter()
                for t in b.column(2).to_pylist():
                    verdict, what, line = ending(t) if t else (COMPLETE, "blank", "")
                    first, two, any_two = opening(line)
                    alone = what == LONE and "\n" not in (t or "").strip()
                    last = _last_word(line or stripped(t or "")[0].rpartition("\n")[2][-200:])
                    out.append((verdict, what, last, first, two, any_two, alone, len(t) if t else 0, None, None, None, "end"))
                    if t:
                        counts.update(_observe(t))
                        words.update(_TOKEN.findall(t))
                classes: Counter[str] = Counter()
                large: Counter[str] = Counter()
                for w, n in words.items():
                    c = _token(w)
                    classes[c] += n
                    if c == "X":
                        large[w] = n
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 12, types))], names=names)
                rows = [(what, w, n) for (what, w), n in counts.items()] + [("word", w, n) for w, n in classes.items()] + [("name", w, n) for w, n in large.items()]
                if rows:
                    none = [pa.nulls(len(rows), c.type) for c in (b.column(0), b.column(1))] + [pa.nulls(len(rows), k) for k in types[:8]]
                    yield pa.RecordBatch.from_arrays([*none, *(pa.array(c, k) for c, k in zip(zip(*rows), types[8:11])), pa.array(["word"] * len(rows))], names=names)

        return self.rows.mapInArrow(run, f"key {kind}, source string, verdict string, kind string, last string, first string, two string, any_two string, alone boolean, size bigint, what string, word string, n bigint, tag string")

    def _ends(self) -> DataFrame:
        columns = ["source", "verdict", "kind", "last", "first", "two", "any_two", "alone", "size"]
        longest = F.max_by(F.struct(*columns), F.struct("size", "source", "verdict", "last", "two"))
        return self.taken.where("tag = 'end'").groupBy("key").agg(longest.alias("r")).select("key", "r.*")

    def _words(self) -> DataFrame:
        """(word, titles, sentences, ends, uses, names): how often lines open with and end in each word, and it stands anywhere, over all documents.

        Words written large count as one under uses, and each for itself under names.
        """
        seen = self.taken.where("tag = 'word'")
        count = lambda what: F.sum(F.when(F.col("what") == what, F.col("n")).otherwise(F.lit(0)))
        return seen.groupBy("word").agg(count("title").alias("titles"), count("sentence").alias("sentences"), count("end").alias("ends"), count("word").alias("uses"), count("name").alias("names"))

    def _limits(self) -> DataFrame:
        """(source, size, censored): lengths at which texts of a source were cut, with the posterior that one of them was."""
        sizes = self.ends.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
        # candidates: the longest length of a source, and lengths that many texts share, or far more than the fit and the lengths near them let expect
        per_source = Window.partitionBy("source")
        sums = sizes.groupBy("source").agg(
            F.sum("n").alias("all"),
            F.max("size").alias("longest"),
            F.sum(F.col("n") * F.log("size")).alias("logs"),
            F.sum(F.col("n") * F.log("size") ** 2).alias("squares"),
        )
        near = F.sum("n").over(Window.partitionBy("source").orderBy("size").rangeBetween(-NEAR, NEAR)) - F.col("n")
        mean = F.col("logs") / F.col("all")
        spread = F.greatest(F.sqrt(F.greatest(F.col("squares") / F.col("all") - mean**2, F.lit(0.0))), F.lit(1e-3))
        fitted = F.col("all") * F.exp(-0.5 * ((F.log("size") - mean) / spread) ** 2) / (math.sqrt(2 * math.pi) * spread * F.col("size"))
        expected = F.greatest(F.col("near") / (2 * NEAR), fitted)
        far_more = (F.col("n") >= 8) & (F.col("n") > expected + DEVIATIONS * F.sqrt(expected))
        spikes = sizes.withColumn("near", near).join(sums, "source").where((F.col("n") >= 3) & ((F.col("size") == F.col("longest")) | (F.col("n") >= F.greatest(F.lit(8), 0.02 * F.col("all"))) | far_more)).drop("near")
        spikes = spikes.withColumn("at", F.sum("n").over(per_source)).withColumn("at_logs", F.sum(F.col("n") * F.log("size")).over(per_source)).withColumn("at_squares", F.sum(F.col("n") * F.log("size") ** 2).over(per_source))

        @F.pandas_udf("double")
        def posterior(n: pd.Series, size: pd.Series, al: pd.Series, logs: pd.Series, squares: pd.Series, at: pd.Series, at_logs: pd.Series, at_squares: pd.Series) -> pd.Series:
            seen = (al - at).to_numpy(float)
            mu, sigma = _censored_fit(seen, (logs - at_logs).to_numpy(float), (squares - at_squares).to_numpy(float), at.to_numpy(float), size.to_numpy(float))
            z = (np.log(size.to_numpy(float)) - mu) / sigma
            expected = al.to_numpy(float) * np.exp(-0.5 * z**2) / (math.sqrt(2 * math.pi) * sigma * size.to_numpy(float))
            return pd.Series(np.clip(1 - expected / n.to_numpy(float), 0.0, 0.999))

        return spikes.select("source", "size", posterior("n", "size", "all", "logs", "squares", "at", "at_logs", "at_squares").alias("censored"))

    def judged(self) -> DataFrame:
        """(key, source, cut, kind, censored): the verdict on every document."""
        known = self.scratch.write("words", self._words())
        rows = self.ends
        lower = F.col("last").rlike("^\\p{Ll}")
        last = F.when(F.col("last").rlike("\\d"), F.lit("9")).when(lower, F.lower("last")).otherwise(F.when(F.col("last") == "", F.lit("")).otherwise(F.lit("X")))
        rows = rows.withColumn("last_class", last)
        line = (F.col("verdict") == OPEN) & F.col("kind").isin(LINE, LONE)
        # how often texts end in a word: with an open line, and at all
        finals = rows.groupBy(F.col("last_class").alias("word")).agg(F.count_if(line).alias("line_finals"), F.count("*").alias("finals"))
        known = known.join(finals, "word", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("line_finals", "finals")})
        known = known.withColumn("inner", F.greatest(F.col("uses") - F.col("finals"), F.lit(0)))
        sure = rows.where(F.col("verdict") != OPEN)
        unsure = rows.where(F.col("verdict") == OPEN)
        totals = known.agg(
            F.coalesce(F.sum(F.col("ends") + F.col("line_finals")), F.lit(0)).alias("all_ends"),
            F.coalesce(F.sum("uses"), F.lit(0)).alias("all_uses"),
            F.coalesce(F.sum(F.when(F.col("inner") == 1, F.col("ends"))), F.lit(0)).alias("single_ends"),
            F.coalesce(F.sum("ends"), F.lit(0)).alias("inner_ends"),
        )
        # the words of the open endings are few; they are looked up in a table of just these
        asked = unsure.select(F.explode(F.array("first", "two", "any_two", "last_class")).alias("word")).distinct()
        wanted = known.join(asked, "word", "left_semi")
        for name, column in (("f", "first"), ("t", "two"), ("a", "any_two"), ("e", "last_class")):
            own = wanted.select(F.col("word").alias(column), *[F.col(c).alias(f"{name}_{c}") for c in ("titles", "sentences", "ends", "uses", "inner", "line_finals")])
            unsure = unsure.join(own, column, "left")
        unsure = unsure.join(F.broadcast(totals))  # one row
        unsure = unsure.join(self._pieces(known, rows, unsure.where(line)), "last", "left").withColumn("piece", F.coalesce("piece", F.lit(False)))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        lean = lambda name: F.log((zero(f"{name}_titles") + 0.5) / (zero(f"{name}_sentences") + 0.5))
        # two words together say more than each, where they were seen at all; a name opens a line but once
        seen = zero("t_titles") + zero("t_sentences") > 0
        title = F.when(seen, lean("t")).otherwise(lean("f") + lean("a")) + F.when(F.col("alone"), 1.0).otherwise(-1.0)
        # a cut falls on words as they stand anywhere, a whole line ends as lines end, other texts' last lines among them
        expected = zero("e_uses") * F.col("all_ends") / F.greatest(F.col("all_uses"), F.lit(1))
        word = F.log((expected + GRANTED) / (zero("e_ends") + F.greatest(zero("e_line_finals") - 1, F.lit(0)) + GRANTED))
        # a word that stands at ends of texts only is a piece of one, unless many whole lines end in words seen once
        single = (F.col("single_ends") + GRANTED) / (F.col("inner_ends") + 2 * GRANTED)
        word = F.when(lower & (zero("e_inner") == 0), F.log(F.lit(PIECES) / single)).otherwise(word)
        word = F.when(F.col("piece"), math.log(PIECES / PIECE_BY_CHANCE)).otherwise(word)
        odds = F.when(F.col("kind") == LONE, math.log(LONE_ODDS) + word - title).when(F.col("kind") == LINE, math.log(LINE_ODDS) + word).otherwise(F.lit(math.log(WHOLE_LINE_ODDS)))
        # an ending that stops inside a word or sentence is cut, a sentence's end never, whatever the length
        certain = F.when(F.col("verdict") == CUT, F.lit(1000.0)).otherwise(F.lit(-1000.0))
        both = sure.select("key", "source", "size", "kind", certain.alias("odds")).unionByName(unsure.select("key", "source", "size", "kind", odds.alias("odds")))
        both = both.join(self.limits, ["source", "size"], "left").withColumn("censored", F.coalesce("censored", F.lit(0.0)))
        length = F.when(F.col("censored") > 0, F.log(F.col("censored") / (1 - F.col("censored")))).otherwise(F.lit(0.0))
        return both.select("key", "source", (F.col("odds") + length > 0).alias("cut"), "kind", "censored")

    @staticmethod
    def _pieces(known: DataFrame, rows: DataFrame, lines: DataFrame) -> DataFrame:
        """(last, piece): the words written large that end open lines, stand nowhere but at ends of texts, and begin a longer word of the corpus."""
        asked = lines.where(F.col("last").rlike("^\\p{Lu}\\p{L}+$")).select("last").distinct()
        ends = rows.groupBy("last").agg(F.count("*").alias("finals"))
        names = known.where("names > 0").select(F.col("word").alias("last"), "names")
        only = asked.join(ends, "last").join(names, "last", "left").where("coalesce(names, 0) <= finals").select("last")
        begins = known.where("names > 0 AND length(word) > 2").select(F.explode(F.transform(F.sequence(F.lit(2), F.length("word") - 1), lambda i: F.substring(F.col("word"), F.lit(1), i))).alias("last"))
        return only.join(begins, "last", "left_semi").select("last", F.lit(True).alias("piece"))

    def found(self) -> DataFrame:
        """The keys of the texts that were cut off."""
        return self.judged().where("cut").select(F.col("key").alias(self.key))

    def rates(self) -> DataFrame:
        """(source, documents, cut, rate, at_limit): how often each source truncates, and how often at a length limit."""
        return (
            self.judged()
            .groupBy("source")
            .agg(F.count("*").alias("documents"), F.count_if("cut").alias("cut"), F.count_if(F.col("cut") & (F.col("censored") > 0.5)).alias("at_limit"))
            .withColumn("rate", F.round(F.col("cut") / F.col("documents"), 6))
        )
