"""Ingest planning, repair, migration of record metadata, keywords and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import records as fn
from docweave.functions import text
from docweave.functions.keys import iso_instant, norm_key
from docweave.functions.text import tokens
from docweave.session import table
from docweave.sources.files import failure, file_type, should_index


def records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_records").dropDuplicates(["record_id"])


def _digest() -> Column:
    return F.substring(F.regexp_replace(norm_key("content_hash"), "^sha256:", ""), 1, 32)


def ingest_plan(spark: SparkSession, d: str) -> DataFrame:
    """Each record of the second half of batches: added, or skipped for its type or because its content is there already."""
    r = records(spark, d).select("record_id", "batch_no", file_type("path").alias("kind"), _digest().alias("hash"))
    old = r.where("batch_no <= 20 AND hash IS NOT NULL").select("hash", F.lit(True).alias("there")).distinct()
    action = F.when(F.col("kind") == "unknown", "skip: type").when(F.col("there"), "skip: duplicate").otherwise("add")
    return r.where("batch_no > 20").join(old, "hash", "left").select("record_id", action.alias("action"))


def watch_filter(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return r.groupBy(should_index(F.col("path"), F.col("file_size"), ["*.pdf", "*.md", "*.txt"], ["*/archive/*"], 5_000_000).alias("reason")).agg(F.count("*").alias("records"))


def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy(F.coalesce(failure(F.col("text"), F.lit(None).cast("string")), F.lit("ok")).alias("class")).agg(F.count("*").alias("documents"))


def find_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each content hash."""
    return records(spark, d).select(_digest().alias("hash"), norm_key("document_id").alias("doc"), "record_id").where("hash IS NOT NULL").groupBy("hash").agg(F.min_by("doc", "record_id").alias("doc"))


def orphan_repair(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that stay when those of unknown documents go, counted by batch."""
    known = records(spark, d).select(norm_key("document_id").alias("doc")).distinct()
    v = table(spark, d, "vector_metadata").dropDuplicates(["vector_id"]).select("batch_no", norm_key("document_id").alias("doc"))
    return v.join(known, "doc", "left_semi").groupBy("batch_no").agg(F.count("*").alias("chunks"))


def suggestion_confirm(spark: SparkSession, d: str) -> DataFrame:
    """Tags a document after all pending suggestions of 0.8 or more are confirmed."""
    s = table(spark, d, "tag_suggestions").select(norm_key("doc_id").alias("doc"), norm_key("tag_name").alias("tag"), norm_key("status").alias("status"), "confidence")
    sure = (F.col("status") == "pending") & ~F.isnan("confidence") & (F.col("confidence") >= 0.8) & (F.col("confidence") <= 1)
    taken = s.where("doc IS NOT NULL").where((F.col("status") == "confirmed") | sure)
    return taken.groupBy("doc").agg(F.count_distinct("tag").alias("tags"))


def tag_names(spark: SparkSession, d: str) -> DataFrame:
    """Suggested names as tags: trimmed, lower case, blanks as hyphens, with their use."""
    name = F.regexp_replace(norm_key("tag_name"), "[ _]+", "-")
    return table(spark, d, "tag_suggestions").dropDuplicates(["id"]).groupBy(name.alias("tag")).agg(F.count("*").alias("n"))


def keywords(spark: SparkSession, d: str) -> DataFrame:
    """The three best words of over three letters of each document by tf x idf; ties go to the first in the alphabet."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    t = docs.select("doc_id", F.explode(tokens("text")).alias("term")).where("length(term) > 3").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    df = t.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    scored = t.join(df, "term").join(F.broadcast(n)).withColumn("score", F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), 6))  # n is one row
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "term"))
    return scored.withColumn("place", place).where("place <= 3").select("doc_id", "term", "score", "place")


def vote(spark: SparkSession, d: str) -> DataFrame:
    """The tag that most sources suggest for a document, and its share of the votes; ties go to the first in the alphabet."""
    s = table(spark, d, "tag_suggestions").select(norm_key("doc_id").alias("doc"), norm_key("tag_name").alias("tag"), norm_key("source").alias("source")).where("doc IS NOT NULL").distinct()
    n = s.groupBy("doc", "tag").agg(F.count("*").alias("votes"))
    best = n.groupBy("doc").agg(F.min(F.struct((-F.col("votes")).alias("v"), "tag")).alias("b"), F.sum("votes").alias("all"))
    return best.select("doc", F.col("b.tag").alias("tag"), F.round(-F.col("b.v") / F.col("all"), 6).alias("share"))


def schema_migrate(spark: SparkSession, d: str) -> DataFrame:
    """Records with their metadata as of the current version: title, language and project, defaults where they were not named."""
    field = lambda k: F.try_variant_get(F.try_parse_json("metadata"), f"$.{k}", "string")
    r = records(spark, d)
    return r.select("record_id", F.coalesce(field("dc_title"), text.title_from_filename("filename")).alias("title"), F.coalesce(field("dc_language"), F.lit("en")).alias("language"), F.lower("file_type").alias("kind"))


def dates(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("record_id", iso_instant("indexed_at").cast("timestamp_ntz").alias("indexed"), fn.year("indexed_at").alias("year"))


def monthly_change(spark: SparkSession, d: str) -> DataFrame:
    """Mean confidence of each month against the month before."""
    s = table(spark, d, "tag_suggestions").dropDuplicates(["id"]).where(F.col("confidence").between(0, 1) & ~F.isnan("confidence"))
    m = s.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.avg("confidence").alias("mean"))
    before = F.lag("mean").over(Window.partitionBy(F.lit(1)).orderBy("month"))  # one row a month
    return m.select("month", F.round("mean", 6).alias("mean"), F.round(F.col("mean") - before, 6).alias("delta"))


def weighted_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Mean confidence by source, weighted by the length of the name, over valid ones of at least 0.5."""
    s = table(spark, d, "tag_suggestions").dropDuplicates(["id"]).where(~F.isnan("confidence") & F.col("confidence").between(0.5, 1))
    size = F.length("tag_name")
    return s.groupBy(norm_key("source").alias("source")).agg(F.round(F.sum(F.col("confidence") * size) / F.sum(size), 6).alias("confidence"))


def failures(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audit_log").dropDuplicates(["id"])
    return a.groupBy("operation").agg(F.count_if(F.col("result") == "success").alias("succeeded"), F.count_if(F.col("result") == "failed").alias("failed"), F.round(F.avg((F.col("result") == "failed").cast("double")), 6).alias("failure_rate"))


def hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    """The default text vector: word counts in 16 hashed places, of length 1, as (doc_id, dim, value)."""
    place = F.conv(F.substring(F.md5("term"), 1, 1), 16, 10).cast("int")
    t = table(spark, d, "documents").select("doc_id", F.explode(tokens("text")).alias("term")).groupBy("doc_id", place.alias("dim")).agg(F.count("*").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id")))
    return t.select("doc_id", "dim", F.round(F.col("n") / length, 6).alias("value"))


def pricing(spark: SparkSession, d: str) -> DataFrame:
    """The relational core on the star tables: revenue by region and year."""
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", F.year("o_orderdate").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("lines"))


_N = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13))), '')"
_REC = "(SELECT DISTINCT ON (record_id) * FROM document_records)"
_SUG = "(SELECT DISTINCT ON (id) * FROM tag_suggestions)"
_HASH = f"regexp_replace({_N.format('content_hash')}, '^sha256:', '')[1:32]"
_TOKS = r"list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_TITLE = "array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(filename, '\\.[^.]+$', ''), '[-_.]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_FIELD = "CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.{}') END"

QUERIES = {
    "ingest_plan": ingest_plan,
    "watch_filter": watch_filter,
    "failure_classes": failure_classes,
    "find_by_hash": find_by_hash,
    "orphan_repair": orphan_repair,
    "suggestion_confirm": suggestion_confirm,
    "suggestion_names": tag_names,
    "keyword_extraction": keywords,
    "ensemble_vote": vote,
    "schema_migrate": schema_migrate,
    "date_parse": dates,
    "evaluation_change": monthly_change,
    "weighted_confidence": weighted_confidence,
    "failures_by_operation": failures,
    "hashed_embedding": hashed_embedding,
    "revenue_by_region": pricing,
}
SQL = {
    "ingest_plan": f"""WITH r AS (SELECT record_id, batch_no, regexp_matches(lower(path), '\\.(pdf|txt|text|md|markdown|html|htm|docx|xlsx|epub)$') AS known, {_HASH} AS hash FROM {_REC}), o AS (SELECT DISTINCT hash, true AS there FROM r WHERE batch_no <= 20 AND hash IS NOT NULL)
SELECT record_id, CASE WHEN NOT known THEN 'skip: type' WHEN there THEN 'skip: duplicate' ELSE 'add' END AS action FROM r LEFT JOIN o USING (hash) WHERE batch_no > 20""",
    "watch_filter": f"""SELECT CASE WHEN contains(path, '/archive/') THEN 'excluded' WHEN file_size > 5000000 THEN 'too_large' WHEN NOT regexp_matches(path, '\\.(pdf|md|txt)$') THEN 'not_included' ELSE 'ok' END AS reason, count(*) AS records FROM {_REC} GROUP BY 1""",
    "failure_classes": """SELECT CASE WHEN coalesce(trim(text), '') = '' THEN 'empty' WHEN length(text) < 50 THEN 'too_short' ELSE 'ok' END AS "class", count(*) AS documents FROM documents GROUP BY 1""",
    "find_by_hash": f"SELECT hash, arg_min(doc, record_id) AS doc FROM (SELECT {_HASH} AS hash, {_N.format('document_id')} AS doc, record_id FROM {_REC}) WHERE hash IS NOT NULL GROUP BY 1",
    "orphan_repair": f"SELECT batch_no, count(*) AS chunks FROM (SELECT DISTINCT ON (vector_id) batch_no, {_N.format('document_id')} AS doc FROM vector_metadata) WHERE doc IN (SELECT {_N.format('document_id')} FROM document_records) GROUP BY 1",
    "suggestion_confirm": f"""SELECT doc, count(DISTINCT tag) AS tags FROM (SELECT {_N.format("doc_id")} AS doc, {_N.format("tag_name")} AS tag, {_N.format("status")} AS status, confidence FROM tag_suggestions)
WHERE doc IS NOT NULL AND (status = 'confirmed' OR (status = 'pending' AND NOT isnan(confidence) AND confidence >= 0.8 AND confidence <= 1)) GROUP BY 1""",
    "suggestion_names": f"SELECT regexp_replace({_N.format('tag_name')}, '[ _]+', '-', 'g') AS tag, count(*) AS n FROM {_SUG} GROUP BY 1",
    "keyword_extraction": f"""WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKS}) AS term FROM documents) WHERE length(term) > 3 GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
s AS (SELECT doc_id, term, round(tf * ln((SELECT count(*) FROM documents WHERE text IS NOT NULL) / df), 6) AS score FROM t JOIN d USING (term))
SELECT doc_id, term, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS INTEGER) AS place FROM s QUALIFY place <= 3""",
    "ensemble_vote": f"""WITH s AS (SELECT DISTINCT {_N.format("doc_id")} AS doc, {_N.format("tag_name")} AS tag, {_N.format("source")} AS source FROM tag_suggestions WHERE {_N.format("doc_id")} IS NOT NULL), n AS (SELECT doc, tag, count(*) AS votes FROM s GROUP BY ALL)
SELECT doc, tag, round(votes / sum(votes) OVER (PARTITION BY doc)::DOUBLE, 6) AS share FROM n QUALIFY row_number() OVER (PARTITION BY doc ORDER BY votes DESC, tag) = 1""",
    "schema_migrate": f"SELECT record_id, coalesce({_FIELD.format('dc_title')}, {_TITLE}) AS title, coalesce({_FIELD.format('dc_language')}, 'en') AS language, lower(file_type) AS kind FROM {_REC}",
    "date_parse": f"""SELECT record_id, CASE WHEN regexp_matches(indexed_at, '([zZ]|[+-][0-9][0-9]:?[0-9][0-9])$') THEN TRY_CAST(indexed_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' ELSE TRY_CAST(indexed_at AS TIMESTAMP) END AS indexed,
 nullif(regexp_extract(indexed_at, '((19|20)[0-9][0-9])', 1), '') AS year FROM {_REC}""",
    "evaluation_change": f"WITH m AS (SELECT strftime(created_at, '%Y-%m') AS month, avg(confidence) AS mean FROM {_SUG} WHERE confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) GROUP BY 1) SELECT month, round(mean, 6) AS mean, round(mean - lag(mean) OVER (ORDER BY month), 6) AS delta FROM m",
    "weighted_confidence": f"SELECT {_N.format('source')} AS source, round(sum(confidence * length(tag_name)) / sum(length(tag_name)), 6) AS confidence FROM {_SUG} WHERE NOT isnan(confidence) AND confidence BETWEEN 0.5 AND 1 GROUP BY 1",
    "failures_by_operation": "SELECT operation, count(*) FILTER (result = 'success') AS succeeded, count(*) FILTER (result = 'failed') AS failed, round(avg(CASE WHEN result = 'failed' THEN 1.0 ELSE 0.0 END), 6) AS failure_rate FROM (SELECT DISTINCT ON (id) * FROM audit_log) GROUP BY 1",
    "hashed_embedding": f"""WITH t AS (SELECT doc_id, CAST(('0x' || md5(term)[1:1])::INTEGER AS INTEGER) AS dim, count(*) AS n FROM (SELECT doc_id, unnest({_TOKS}) AS term FROM documents) GROUP BY ALL)
SELECT doc_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)::DOUBLE), 6) AS value FROM t""",
    "revenue_by_region": """SELECT r_name, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
}
