"""Text clean-up, quality, personal data, citations, chunks and pages."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import chunks, html, pii, quality, text
from docweave.functions.stem import fold
from docweave.operators import answers
from docweave.functions.keys import norm_key
from docweave.session import table

BOILERPLATE = r"^\s*(kind regards|bien cordialement|un cordial saludo|mit freundlichen|owner:|reviewer:|tag:|ref:)"
CAPTION = r"^\s*(figure|fig\.|table|tableau|abbildung|tabla|figura|\|)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def normalise_universal(spark: SparkSession, d: str) -> DataFrame:
    fixed = text.universal_fixes("text")
    return docs(spark, d).select("doc_id", F.length(fixed).alias("size"), F.md5(fixed).alias("digest"))


def line_breaks(spark: SparkSession, d: str) -> DataFrame:
    fixed = text.html_line_breaks("text")
    return docs(spark, d).select("doc_id", F.length(fixed).alias("size"), F.md5(fixed).alias("digest"))


def boilerplate(spark: SparkSession, d: str) -> DataFrame:
    kept = text.keep_lines("text", BOILERPLATE)
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", F.md5(kept).alias("digest"), (F.length("text") - F.length(kept)).alias("removed"))


def captions(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are captions or table rows removed, unless that takes more than half of the text."""
    kept = text.keep_lines("text", CAPTION)
    result = F.when(F.length(kept) * 2 >= F.length("text"), kept).otherwise(F.col("text"))
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", F.md5(result).alias("digest"), (F.length(kept) < F.length("text")).alias("has_caption"))


def hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_records").select("record_id", text.document_id("path").alias("id"), text.content_hash("filename").alias("name_hash"), text.title_from_filename("filename").alias("title"))


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.token_count("text").alias("tokens"), text.shorten("text", 80).alias("preview"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """The five scores of each document as text of no known type, its recorded size being n_chars."""
    scores = (quality.extraction_completeness("text", F.col("n_chars")), quality.extraction_characters("text"), quality.extraction_structure("text"), quality.extraction_images("text"), quality.extraction_tables("text"))
    q = docs(spark, d).select("doc_id", "doc_type", *[F.round(c, 6).alias(n) for n, c in zip(quality.WEIGHTS, scores)])
    return q.withColumn("overall", quality.extraction_overall(*[F.col(n) for n in quality.WEIGHTS]))


def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).drop("doc_type").withColumn("grade", quality.grade(F.col("overall")))


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("overall")
    bands = {"excellent": o >= 0.9, "good": (o >= 0.7) & (o < 0.9), "fair": (o >= 0.5) & (o < 0.7), "poor": o < 0.5}
    return _scored(spark, d).groupBy("doc_type").agg(F.count("*").alias("documents"), F.round(F.avg("overall"), 5).alias("mean"), *[F.count_if(c).alias(n) for n, c in bands.items()])


def _extractions(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "document_records").select(norm_key("document_id").alias("document"), "record_id", norm_key("file_type").alias("file_type"), "file_size").where("document IS NOT NULL")
    r = r.groupBy("document").agg(F.max_by(F.struct("file_type", "file_size"), "record_id").alias("r")).select("document", "r.*")
    v = table(spark, d, "vector_metadata").select(norm_key("document_id").alias("document"), "vector_id", "content").where("document IS NOT NULL AND content IS NOT NULL").dropDuplicates(["vector_id"])
    v = v.groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vector_id", "content"))), lambda x: x["content"]), "\n\n").alias("text"))
    kind = F.col("file_type")
    scores = {
        "completeness": quality.extraction_completeness("text", F.col("file_size"), kind),
        "characters": quality.extraction_characters("text"),
        "structure": quality.extraction_structure("text", kind),
        "images": quality.extraction_images("text", kind),
        "tables": quality.extraction_tables("text", kind),
    }
    j = r.join(v, "document", "left").select("document", "file_type", *[F.when(F.col("text").isNotNull(), c).alias(n) for n, c in scores.items()])
    overall = quality.extraction_overall(*[F.col(n) for n in scores])
    return j.withColumn("overall", overall)


def extraction_scores(spark: SparkSession, d: str) -> DataFrame:
    """The quality of each stored document, from its latest record and the texts of its chunks in order, worst first. Scores are null without chunks, the overall one without a file size too."""
    return _extractions(spark, d).orderBy(F.asc_nulls_last("overall"), "document")


def extraction_report(spark: SparkSession, d: str, threshold: float = 0.7) -> DataFrame:
    """Counts and means of extraction_scores: a row for each file type and, with is_total, one for all. Documents without an overall score are errors and in no band."""
    q = _extractions(spark, d)
    o = F.col("overall")
    bands = {"excellent": o >= 0.9, "good": (o >= 0.7) & (o < 0.9), "fair": (o >= 0.5) & (o < 0.7), "poor": o < 0.5, "low": o < threshold}
    means = [F.round(F.avg(n), 4).alias(n) for n in ("overall", *quality.WEIGHTS)]
    return q.rollup("file_type").agg((F.grouping("file_type") == 1).alias("is_total"), F.count("*").alias("documents"), F.count_if(o.isNull()).alias("errors"), *means, *[F.count_if(c).alias(n) for n, c in bands.items()])


def pii_counts(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", *pii.counts("text"))


def pii_report(spark: SparkSession, d: str) -> DataFrame:
    """Findings by type, with the documents they are in."""
    found = docs(spark, d).select(*pii.counts("text"))
    each = found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("type"), F.col(f"n_{k.lower()}").alias("n")) for k in pii.PATTERNS])).alias("x")).select("x.*")
    return each.groupBy("type").agg(F.sum("n").cast("bigint").alias("findings"), F.count_if(F.col("n") > 0).alias("documents"))


def pii_redact(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its personal data covered sign by sign; the length stays."""
    clean = pii.masked("text")
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", F.md5(clean).alias("digest"), F.length(clean).alias("size"))


def languages(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", quality.language("text").alias("language"))


def citation_markers(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.explode(quality.citation_markers("text")).alias("marker"))


def citation_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk as a claim against the chunk that comes before it in its document's numbering."""
    v = table(spark, d, "vector_metadata").dropDuplicates(["vector_id"]).select("vector_id", "content").where("content IS NOT NULL")
    source = v.select((F.col("vector_id") + 1).alias("vector_id"), F.col("content").alias("source"))
    shared = answers.overlap("content", "source")
    said = answers.verdict(shared)
    return v.join(source, "vector_id").select("vector_id", shared.alias("overlap"), said["verdict"].alias("verdict"), said["confidence"].alias("confidence"))


def citation_formats(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "document_records").dropDuplicates(["record_id"])
    year = F.nullif(F.regexp_extract("indexed_at", "((19|20)[0-9]{2})", 1), F.lit(""))
    parts = (text.title_from_filename("filename"), F.lit(None).cast("string"), year, F.col("filename"))
    return r.select("record_id", *[quality.format_citation(s, *parts).alias(s) for s in ("apa", "mla", "chicago", "bibtex", "markdown", "inline")])


def domains(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://www."), F.col("source"), F.lit(".Example.org:8080/doc/"), F.col("doc_id").cast("string"))
    return docs(spark, d).where(norm_key("source").isNotNull()).select("doc_id", text.url_domain(F.translate(url, " \t\n", "")).alias("domain"))


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    c = docs(spark, d).select("doc_id", F.explode(chunks.fixed_windows("text", 64, 8)).alias("c"))
    return c.select("doc_id", F.col("c.start").alias("start"), F.md5("c.content").alias("digest"))


def chunked(strategy: str, spark: SparkSession, d: str) -> DataFrame:
    c = docs(spark, d).select("doc_id", F.explode(chunks.chunk_column("text", strategy, 128, 16, 32)).alias("c"))
    return c.select("doc_id", "c.*")


def pages(spark: SparkSession, d: str) -> DataFrame:
    """The documents as HTML pages."""
    clean = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(
        F.lit("<html><head><title>Document "), F.col("doc_id").cast("string"), F.lit("</title><meta property='og:title' content='"), F.coalesce(norm_key("source"), F.lit("")),
        F.lit("'><meta name='author' content='"), F.coalesce("doc_type", F.lit("")), F.lit("'></head><body><nav>home</nav>"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("<aside>a</aside><aside>b</aside>")).otherwise(F.lit("")),
        F.lit("<main><h1>Heading</h1><p>"), clean, F.lit("</p><table><tr><td>k</td><td>v</td></tr></table></main><footer>foot</footer></body></html>"),
    )
    return docs(spark, d).select("doc_id", page.alias("html"))


def chunk_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The letters and digits of each document that the chunks of each strategy hold, overlaps once: all of them, if nothing is lost."""
    rows = docs(spark, d).where("text IS NOT NULL")
    out = None
    for strategy in chunks.STRATEGIES:
        c = rows.select("doc_id", "text", chunks.chunk_column("text", strategy, 128, 16, 32).alias("c"))
        step = lambda acc, x: F.struct(
            F.greatest(acc["at"], x["stop"]).alias("at"),
            (acc["n"] + F.length(F.regexp_replace(F.substring(F.col("text"), F.greatest(acc["at"], x["start"]) + 1, F.greatest(x["stop"] - F.greatest(acc["at"], x["start"]), F.lit(0))), r"[^\p{L}\p{N}]", ""))).alias("n"),
        )
        held = F.aggregate("c", F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), step)
        one = c.select("doc_id", F.lit(strategy).alias("strategy"), held["n"].alias("characters"))
        out = one if out is None else out.unionByName(one)
    return out


def html_meta(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("doc_id", html.title("html").alias("title"), html.meta("html", "author").alias("author"), html.best_title("html").alias("best_title"), html.complexity("html").alias("complexity"), html.needs_script("html").alias("needs_script"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d).select("doc_id", html.page_column("html").alias("p"))
    return p.select("doc_id", "p.text", F.size("p.headings").alias("headings"), F.element_at("p.tables", 1).alias("first_table"))


def _g(expr: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        expr = f"regexp_replace({expr}, '{a}', '{b}', 'g')"
    return expr


_ZW = "chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279)"
_UNI = "trim(" + _g(f"translate(text, {_ZW}, '')", ("\\r\\n?", "\\n"), ("[ \\t]+", " "), (" ?\\n ?", "\\n"), ("\\n{3,}", "\\n\\n")) + ", ' ' || chr(10) || chr(9))"
_UNI = _UNI.replace("'\\n\\n'", "chr(10) || chr(10)").replace("'\\n', 'g'", "chr(10), 'g'")
_LB = _g("text", ("([a-z])-\\n([a-z])", "\\1\\2"), ("([a-z,;])\\n([a-z])", "\\1 \\2"), ("[ \\t]+", " "), ("\\n{3,}", "\\n\\n")).replace("'\\n\\n', 'g'", "chr(10) || chr(10), 'g'")
_TOKS = r"list_filter(regexp_split_to_array(strip_accents(lower({})), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _lines(pattern: str) -> str:
    return f"array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(lower(x), '{pattern}')), chr(10))"


def _count(pattern: str, of: str = "text") -> str:
    return f"coalesce(len(regexp_extract_all({of}, '{pattern}')), 0)"


_TITLE = "array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(filename, '\\.[^.]+$', ''), '[-_.]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_HAS = lambda p, flags="": f"coalesce(regexp_matches(text, '{flags}{p}'), false)"
_QUAL = f"""q0 AS (SELECT doc_id, doc_type, text, length(text)::DOUBLE AS size, coalesce(length(text), 0)::DOUBLE / nullif(n_chars, 0) AS r, n_chars,
 (length(text) - length({_g("text", ("�+", ""))})) + (length(text) - length({_g("text", ("â€[™œ]", ""))})) + (length(text) - length({_g("text", ("Ã[\\x{80}-\\x{bf}]", ""))})) + (length(text) - length({_g("text", ("ï»¿", ""))})) + (length(text) - length({_g("text", ("[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]", ""))})) AS bad,
 length(text) - length({_g("text", ("\\p{C}", ""))}) AS other,
 {" + ".join(_count("(?m)" + p.replace("'", "''")) for p in quality.STRUCTURE)} AS marks FROM documents),
q1 AS (SELECT doc_id, doc_type, round(CASE WHEN n_chars = 0 THEN 0.0 WHEN n_chars IS NOT NULL THEN least(1.0, greatest(0.0, CASE WHEN r < 0.005 THEN r / 0.005 * 0.3 WHEN r < 0.05 THEN 0.3 + (r - 0.005) / 0.045 * 0.4 WHEN r <= 0.5 THEN 0.7 + (r - 0.05) / 0.45 * 0.3 ELSE greatest(0.5, 1 - (r - 0.5)) END)) END, 6) AS completeness,
 CASE WHEN size > 0 THEN CASE WHEN bad = 0 AND other / size < 0.01 THEN 1.0 WHEN bad / size < 0.001 THEN 0.95 WHEN bad / size < 0.01 THEN 0.8 WHEN bad / size < 0.05 THEN 0.5 ELSE round(greatest(0.0, 0.3 - bad / size), 6) END ELSE 0.0 END AS characters,
 round(CASE WHEN size > 0 THEN CASE WHEN marks = 0 AND size > 500 THEN 0.3 WHEN marks < size / 1000 THEN 0.5 + marks / (size / 1000) * 0.3 WHEN marks < size / 500 THEN 0.8 + (marks - size / 1000) / (size / 1000) * 0.15 ELSE 0.95 END ELSE 0.0 END, 6) AS structure,
 CASE WHEN size > 0 THEN CASE WHEN {_HAS(quality.IMAGES["caption"], "(?im)")} OR {_HAS(quality.IMAGES["placeholder"], "(?im)")} OR {_HAS(quality.IMAGES["markdown"])} THEN 0.85 ELSE 0.7 END ELSE 0.0 END AS images,
 CASE WHEN size > 0 THEN CASE WHEN {_HAS(quality.TABLES["row"])} AND {_HAS(quality.TABLES["header"])} THEN 0.95 WHEN {_HAS(quality.TABLES["placeholder"])} THEN 0.7 ELSE 0.6 END ELSE 0.0 END AS tables FROM q0),
q AS (SELECT *, round(0.30::DOUBLE * completeness + 0.25::DOUBLE * characters + 0.20::DOUBLE * structure + 0.15::DOUBLE * images + 0.10::DOUBLE * tables, 4) AS overall FROM q1)"""
_YEAR = "coalesce(nullif(regexp_extract(indexed_at, '((19|20)[0-9]{2})', 1), ''), 'n.d.')"
_WORDS = "list_distinct(list_filter(" + _TOKS + ", lambda x: length(x) > 2 AND x NOT IN (" + ", ".join(f"'{w}'" for w in answers.STOP_WORDS) + ")))"
_PII = {k: f"len(list_filter(coalesce(regexp_extract_all(text, '{p}'), []), lambda m: NOT regexp_matches(m, '{pii.ALLOWED}')))" for k, p in pii.PATTERNS.items()}
_LANG = ", ".join(f"[len(list_filter({_TOKS.format('text')}, lambda x: x IN ({', '.join(repr(fold(w)) for w in ws)}))), {-i}]" for i, ws in enumerate(quality.STOP_WORDS.values()))

QUERIES = {
    "normalise_universal": normalise_universal,
    "html_line_breaks": line_breaks,
    "boilerplate_lines": boilerplate,
    "caption_removal": captions,
    "document_hashes": hashes,
    "token_sizes": sizes,
    "quality_scores": quality_scores,
    "quality_report": quality_report,
    "extraction_scores": extraction_scores,
    "extraction_report": extraction_report,
    "pii_counts": pii_counts,
    "pii_report": pii_report,
    "pii_redact": pii_redact,
    "language_detect": languages,
    "citation_markers": citation_markers,
    "citation_verdicts": citation_verdicts,
    "citation_formats": citation_formats,
    "url_domain": domains,
    "chunk_fixed_windows": chunk_windows,
    **{f"chunk_{s}": partial(chunked, s) for s in chunks.STRATEGIES},
    "chunk_coverage": chunk_coverage,
    "html_meta": html_meta,
    "html_text": html_text,
}
SQL = {
    "normalise_universal": f"SELECT doc_id, CAST(length(x) AS INTEGER) AS size, md5(x) AS digest FROM (SELECT doc_id, {_UNI} AS x FROM documents)",
    "html_line_breaks": f"SELECT doc_id, CAST(length(x) AS INTEGER) AS size, md5(x) AS digest FROM (SELECT doc_id, {_LB} AS x FROM documents)",
    "boilerplate_lines": f"SELECT doc_id, md5(x) AS digest, CAST(length(text) - length(x) AS INTEGER) AS removed FROM (SELECT doc_id, text, {_lines(BOILERPLATE)} AS x FROM documents WHERE text IS NOT NULL)",
    "caption_removal": f"SELECT doc_id, md5(CASE WHEN length(x) * 2 >= length(text) THEN x ELSE text END) AS digest, length(x) < length(text) AS has_caption FROM (SELECT doc_id, text, {_lines(CAPTION)} AS x FROM documents WHERE text IS NOT NULL)",
    "document_hashes": f"SELECT record_id, sha256(path)[1:16] AS id, sha256(filename)[1:32] AS name_hash, {_TITLE} AS title FROM document_records",
    "token_sizes": "SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS tokens, CASE WHEN length(x) > 80 THEN x[1:77] || '...' ELSE x END AS preview FROM (SELECT doc_id, text, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS x FROM documents)",
    "quality_scores": f"WITH {_QUAL} SELECT doc_id, completeness, characters, structure, images, tables, overall, CASE WHEN overall >= 0.9 THEN 'A' WHEN overall >= 0.8 THEN 'B' WHEN overall >= 0.7 THEN 'C' WHEN overall >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM q",
    "quality_report": f"WITH {_QUAL} SELECT doc_type, count(*) AS documents, round(avg(overall), 5) AS mean, count(*) FILTER (overall >= 0.9) AS excellent, count(*) FILTER (overall >= 0.7 AND overall < 0.9) AS good, count(*) FILTER (overall >= 0.5 AND overall < 0.7) AS fair, count(*) FILTER (overall < 0.5) AS poor FROM q GROUP BY 1",
    "pii_counts": "SELECT doc_id, " + ", ".join(f"CAST({c} AS INTEGER) AS n_{k.lower()}" for k, c in _PII.items()) + " FROM documents",
    "pii_report": " UNION ALL ".join(f"SELECT '{k}' AS type, CAST(sum({c}) AS BIGINT) AS findings, count(*) FILTER ({c} > 0) AS documents FROM documents" for k, c in _PII.items()),
    "language_detect": f"SELECT doc_id, CASE WHEN b[1] > 0 THEN ({list(quality.STOP_WORDS)})[1 - b[2]] END AS language FROM (SELECT doc_id, list_max([{_LANG}]) AS b FROM documents)",
    "citation_markers": "SELECT DISTINCT doc_id, CAST(unnest(flatten(list_transform(regexp_extract_all(text, '\\[([0-9]+(;[0-9]+)*)\\]', 1), lambda g: string_split(g, ';')))) AS INTEGER) AS marker FROM documents",
    "citation_verdicts": f"""WITH v AS (SELECT DISTINCT ON (vector_id) vector_id, content FROM vector_metadata WHERE content IS NOT NULL), j AS (SELECT v.vector_id, {_WORDS.format("v.content")} AS a, {_WORDS.format("s.content")} AS b FROM v JOIN v s ON v.vector_id = s.vector_id + 1),
o AS (SELECT vector_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a)::DOUBLE ELSE 0 END, 4) AS overlap FROM j) SELECT *, CASE WHEN overlap >= 0.3 THEN 'valid' WHEN overlap >= 0.15 THEN 'weak' ELSE 'invalid' END AS verdict, round(CASE WHEN overlap >= 0.3 THEN least(1.0, overlap + 0.3) WHEN overlap >= 0.15 THEN overlap + 0.2 ELSE overlap * 0.3 END + 1e-9, 4) AS confidence FROM o""",
    "citation_formats": f"""WITH r AS (SELECT DISTINCT ON (record_id) record_id, filename, {_TITLE} AS t, {_YEAR} AS y FROM document_records)
SELECT record_id, filename || ' (' || y || '). ' || t || '.' AS apa, filename || '. "' || t || '." ' || y || '.' AS mla, filename || '. ' || t || '. ' || y || '.' AS chicago,
 '@misc{{' || regexp_replace(lower(filename), '[^a-z0-9]+', '_', 'g') || ', title={{' || t || '}}, year={{' || y || '}}}}' AS bibtex, '[' || t || '](' || filename || ')' AS markdown, '(' || filename || ', ' || y || ')' AS inline FROM r""",
    "url_domain": "SELECT doc_id, lower(translate(source, ' ' || chr(9) || chr(10), '')) || '.example.org' AS domain FROM documents WHERE trim(source, ' ' || chr(9) || chr(10) || chr(13)) <> ''",
    "chunk_fixed_windows": "SELECT doc_id, CAST(start AS INTEGER) AS start, md5(text[start + 1:start + 256]) AS digest FROM (SELECT doc_id, text, unnest(range(0, length(text), 224)) AS start FROM documents WHERE length(text) > 0)",
    "chunk_coverage": f"SELECT doc_id, strategy, CAST(length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS INTEGER) AS characters FROM documents, (SELECT unnest({list(chunks.STRATEGIES)}) AS strategy) WHERE text IS NOT NULL",
    "html_meta": """SELECT doc_id, 'Document ' || doc_id AS title, coalesce(doc_type, '') AS author, coalesce(nullif(lower(trim(source, ' ' || chr(9) || chr(10) || chr(13))), ''), 'Document ' || doc_id) AS best_title,
 CASE WHEN doc_id % 3 = 0 THEN 'moderate' ELSE 'simple' END AS complexity, false AS needs_script FROM documents""",
}
