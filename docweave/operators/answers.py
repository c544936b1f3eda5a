"""From results to an answer and its citations: context, citations, verdicts, fallback, correction."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.text import tokens

RELEVANCE, LOWERED, BOOSTED, SURE = 0.5, 0.35, 0.6, 0.9


def group_key(rows: DataFrame) -> Column:
    """What tells documents apart: the content's hash, else the document's id, else its source; null for none of them."""
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("content_hash", "document_id", "source") if c in rows.columns]
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def relevant(results: DataFrame, least: float, most: int, score: str = "score", key: str = "id") -> DataFrame:
    """The most results of at least a score, best first; ties go to the smaller key."""
    return results.where(F.col(score) >= least).orderBy(F.desc(score), key).limit(most)


def grouped(results: DataFrame, order: str = "rank") -> DataFrame:
    """results with doc_group and group_position: documents in the order in which they are first seen, from 1. Rows without a document are one group each."""
    key = F.coalesce(group_key(results), F.concat(F.lit("row "), F.col(order).cast("string")))
    first = results.withColumn("doc_group", key).withColumn("__first", F.min(order).over(Window.partitionBy("doc_group")))
    place = first.select("doc_group", "__first").distinct().withColumn("group_position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("__first", "doc_group")))  # documents of one answer
    return first.drop("__first").join(place.drop("__first"), "doc_group")


def document_citations(chunks: DataFrame, order: str = "rank") -> DataFrame:
    """One row a document of the chunks: its best chunk's id, filename and content, its best score, all pages sorted, how many chunks."""
    g = grouped(chunks, order)
    first = F.min_by(F.struct("id", "filename", "content"), order)
    out = g.groupBy("doc_group", "group_position").agg(first.alias("f"), F.max("score").alias("score"), F.array_sort(F.collect_set("page")).alias("all_pages"), F.count("*").alias("chunks"))
    return out.select("doc_group", "group_position", "f.*", "score", "all_pages", "chunks")


def distinct_citations(citations: DataFrame, score: str = "score") -> DataFrame:
    """Citations (filename, page, ...) without repeats of a place: of each filename and page the best."""
    best = F.row_number().over(Window.partitionBy("filename", "page").orderBy(F.desc(score), "id"))
    return citations.withColumn("__r", best).where("__r = 1").drop("__r")


def cited_claims(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, citation, claim): each number of a [1] or [1;2] marker with the sentence it stands in, the markers taken out."""
    sentences = F.split(F.col(text), r"(?<=[.!?])\s+(?!\[)")
    each = answers.select(F.col(key), F.explode(sentences).alias("__s"))
    marks = F.flatten(F.transform(F.regexp_extract_all("__s", F.lit(r"\[(\d+(?:;\d+)*)\]"), F.lit(1)), lambda m: F.split(m, ";")))
    claim = F.btrim(F.regexp_replace(F.regexp_replace("__s", r"\s*\[\d+(?:;\d+)*\]", ""), r"\s+", " "))
    return each.select(key, F.explode(F.array_distinct(marks)).alias("citation"), claim.alias("claim")).select(key, F.col("citation").cast("int").alias("citation"), "claim")


def joined_citations(claims: DataFrame, citations: DataFrame, key: str) -> DataFrame:
    """claims with the citation each number names (key, citation, content); in_range is false where there is none."""
    there = citations.select(key, "citation", F.col("content").alias("source"), F.lit(True).alias("__there"))
    return claims.join(there, [key, "citation"], "left").withColumn("in_range", F.coalesce("__there", F.lit(False))).drop("__there")


# Words that say nothing of a claim's subject.
STOP_WORDS = "the a an is are was were be been being have has had do does did will would could should may might must shall to of in for on with at by from as into through during before after above below between under again further then once and but or nor so yet both either neither not only own same than too very just also now it its this that these those such can about".split()


def claim_words(text: str | Column) -> Column:
    """The distinct words of over two letters that are no stop words."""
    return F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def overlap(claim: str | Column, source: str | Column) -> Column:
    """The share of the claim's words that the source has; 0 for a claim without any."""
    c = claim_words(claim)
    return F.round(F.coalesce(F.when(F.size(c) > 0, F.size(F.array_intersect(c, claim_words(source))) / F.size(c)), F.lit(0.0)), 4)


def verdict(shared: Column, semantic: Column | None = None) -> Column:
    """(verdict, confidence): valid from 0.3 shared words on (confidence 0.3 more, at most 1); else by meaning from 0.7 valid and from 0.5
    weak; else weak from 0.15 on (0.2 more); else invalid with 0.3 of it."""
    out = lambda v, c: F.struct(F.lit(v).alias("verdict"), F.round(c + 1e-9, 4).alias("confidence"))
    r = F.when(shared >= 0.3, out("valid", F.least(F.lit(1.0), shared + 0.3)))
    if semantic is not None:
        r = r.when(semantic >= 0.7, out("valid", semantic)).when(semantic >= 0.5, out("weak", semantic))
    return r.when(shared >= 0.15, out("weak", shared + 0.2)).otherwise(out("invalid", shared * 0.3))


def unused(citations: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """The citations of each answer that no marker names."""
    return citations.join(claims.select(key, "citation").distinct(), [key, "citation"], "left_anti")


def resolved(references: DataFrame, documents: DataFrame) -> DataFrame:
    """References (question, author, year, confidence) joined to documents (document_id, author, year): by author and year, author alone, or year alone.

    One row a reference and document, the best confidence of each.
    """
    d = documents.select("document_id", F.col("author").alias("__a"), F.col("year").alias("__y"))
    by_author = references.where("author <> ''").join(d, (F.col("author") == F.col("__a")) & (F.col("year").isNull() | (F.col("year") == F.col("__y"))))
    by_year = references.where("author = '' AND year IS NOT NULL").join(d, F.col("year") == F.col("__y"))
    return by_author.unionByName(by_year).groupBy("question", "document_id").agg(F.max("confidence").alias("confidence"))


def by_filename(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """(question, document_id, confidence): documents whose filename's words a question has, the share of them, at most 0.7."""
    words = documents.select("document_id", F.explode(F.array_distinct(F.filter(tokens(F.regexp_replace("filename", r"\.[^.]+$", "")), lambda w: F.length(w) > 2))).alias("w"))
    sizes = words.groupBy("document_id").agg(F.count("*").alias("n"))
    asked = questions.select("question", F.explode(F.array_distinct(tokens("question"))).alias("w"))
    met = asked.join(words, "w").groupBy("question", "document_id").agg(F.count("*").alias("met"))
    return met.join(sizes, "document_id").select("question", "document_id", F.round(F.least(F.lit(0.7), F.col("met") / F.col("n")), 4).alias("confidence"))


# Words that refer to what was said before; they count wherever they stand in the question.
INDICATORS = "it|this|that|these|those|the concept|the topic|the subject|paper|document|article|more about|else about|what else|tell me more|elaborate|expand|continue|go on|and"


def needs_rewrite(question: str | Column) -> Column:
    """Whether a question refers back, by an indicator anywhere in it, inside a word too."""
    q = F.lower(F.col(question) if isinstance(question, str) else question)
    return F.coalesce(q.rlike(INDICATORS), F.lit(False))


@dataclass
class Retrieved:
    """What a cascade found, and by which step."""

    results: DataFrame | None
    step: str


def cascade(search: Callable[[str, list[str] | None, float], DataFrame], question: str, rewritten: str | None = None, reference: tuple[list[str], float] | None = None) -> Retrieved:
    """The first step that finds something.

    search takes a query, documents to keep to, and a least score. Steps: a sure reference's documents; the rewritten question, for
    a fair reference too; the question; the question with a lower score.
    """
    steps: list[tuple[str, str, list[str] | None, float]] = []
    if reference and reference[1] >= SURE:
        steps.append(("reference", question, reference[0], RELEVANCE))
    if rewritten and rewritten != question:
        steps.append(("boosted" if reference and reference[1] >= BOOSTED else "rewritten", rewritten, None, RELEVANCE))
    steps += [("question", question, None, RELEVANCE), ("lowered", question, None, LOWERED)]
    for name, query, documents, least in steps:
        found = search(query, documents, least)
        if not found.isEmpty():
            return Retrieved(found, name)
    return Retrieved(None, "none")


def correct(ask: Callable[[str], tuple[str, float]], judge: Callable[[str, str], float], rewrite: Callable[[str], str], refine: Callable[[str, str], str], question: str, least_relevance: float = 0.6, least_faith: float = 0.7, rewrites: int = 2, refinements: int = 1) -> dict:
    """A question asked again, rewritten, while what is found is not relevant enough, and its answer refined while it is not faithful enough.

    ask gives an answer and the relevance of what it rests on, judge an answer's faithfulness.
    """
    query, done = question, 0
    answer, relevance = ask(query)
    while relevance < least_relevance and done < rewrites:
        query, done = rewrite(query), done + 1
        again = ask(query)
        if again[1] > relevance:
            answer, relevance = again
    faith, refined = judge(question, answer), 0
    while faith < least_faith and refined < refinements:
        answer, refined = refine(question, answer), refined + 1
        faith = judge(question, answer)
    return {"answer": answer, "query": query, "rewrites": done, "refinements": refined, "relevance": relevance, "faithfulness": faith, "confidence": round(0.4 * relevance + 0.6 * faith, 4)}


def recent_documents(turns: DataFrame, session: str, turn: str, cited: str, most: int) -> DataFrame:
    """(session, document, position): the distinct documents cited in a session, the latest first, the most of each session."""
    each = turns.select(session, turn, F.posexplode(cited).alias("__i", "document")).where("document IS NOT NULL")
    last = each.groupBy(session, "document").agg(F.max(F.struct(F.col(turn), -F.col("__i"))).alias("__at"))
    place = F.row_number().over(Window.partitionBy(session).orderBy(F.desc("__at"), "document"))
    return last.withColumn("position", place).where(F.col("position") <= most).select(session, "document", "position")


def score_in(response: str | Column) -> Column:
    """The first number of a response, between 0 and 1; null without one."""
    found = F.regexp_extract(F.col(response) if isinstance(response, str) else response, r"(-?\d+(?:\.\d+)?)", 1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(found != "", found.cast("double")))) * F.when(found != "", F.lit(1.0))


def winner(judgement: str | Column) -> Column:
    """A, B or tie of a judge's JSON (winner, or score_a and score_b); tie where neither is to be read."""
    v = F.try_parse_json(F.col(judgement) if isinstance(judgement, str) else judgement)
    said = F.upper(F.try_variant_get(v, "$.winner", "string"))
    a, b = (F.try_variant_get(v, f"$.score_{x}", "double") for x in "ab")
    return F.when(said.isin("A", "B"), said).when(said.isNull() & (a > b), "A").when(said.isNull() & (b > a), "B").otherwise("tie")


def prompt(template: str, **columns: Column) -> Column:
    """A template with {name} parts filled in from columns; nulls as nothing. ValueError for a part without a column."""
    import re

    pieces = re.split(r"\{(\w+)\}", template)
    missing = [p for p in pieces[1::2] if p not in columns]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    return F.concat(*[F.coalesce(columns[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def summary(text: str | Column, most: int) -> Column:
    """A text cut to its size: at the last sentence's end in the last fifth, else hard with three dots."""
    t = F.btrim(F.col(text) if isinstance(text, str) else text)
    head = F.substring(t, 1, most)
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    return F.when(F.length(t) <= most, t).when(F.length(whole) >= 0.8 * most, whole).otherwise(F.concat(F.rtrim(F.substring(t, 1, max(most - 3, 0))), F.lit("...")))


def category(response: str | Column, allowed: list[str]) -> Column:
    """A response's category in lower case if it is an allowed one, else other."""
    c = F.lower(F.btrim(F.col(response) if isinstance(response, str) else response, F.lit(" .\n\t\"'")))
    return F.when(c.isin(*allowed), c).otherwise(F.lit("other"))


def contextual(chunk: str | Column, context: Column, most: int = 200) -> Column:
    """A chunk under its context, of at most so many characters; as it is without one."""
    c = F.col(chunk) if isinstance(chunk, str) else chunk
    head = F.substring(F.btrim(context), 1, most)
    return F.when(F.coalesce(F.length(head), F.lit(0)) > 0, F.concat(head, F.lit("\n\n"), c)).otherwise(c)
