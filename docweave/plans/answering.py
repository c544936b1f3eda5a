"""Context, citations and conversations; entities, measures, pages and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import cleanup, layout, pii
from docweave.functions.keys import norm_key
from docweave.operators import answers, engines, entities, measures
from docweave.session import table


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vector_metadata").dropDuplicates(["vector_id"])


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Results of a made-up ranking: the chunks that name the archive, a shorter one being better."""
    v = chunks(spark, d).where("content LIKE '%archive%'").select(F.col("vector_id").alias("id"), norm_key("document_id").alias("document_id"), "content", F.col("batch_no").alias("page"))
    score = F.round(100.0 / F.length("content"), 6)
    best = v.withColumn("score", score).orderBy(F.desc("score"), "id").limit(60)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "id"))).withColumn("filename", F.concat("document_id", F.lit(".txt")))


def context_groups(spark: SparkSession, d: str) -> DataFrame:
    """Results grouped by document in the order in which documents are first seen."""
    return answers.grouped(_results(spark, d)).select("id", "rank", "doc_group", "group_position")


def context_citations(spark: SparkSession, d: str) -> DataFrame:
    """One citation a document, with all its pages."""
    return answers.document_citations(_results(spark, d)).select("group_position", "id", "score", F.array_join(F.transform("all_pages", lambda x: x.cast("string")), ",").alias("pages"), "chunks")


def context_relevant(spark: SparkSession, d: str) -> DataFrame:
    return answers.relevant(_results(spark, d), 0.6, 10).select("id", "score")


def citations_distinct(spark: SparkSession, d: str) -> DataFrame:
    return answers.distinct_citations(_results(spark, d)).select("filename", "page", "id")


def questions_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """Texts that would be rewritten as questions, by language."""
    docs = table(spark, d, "documents")
    return docs.groupBy(norm_key("lang").alias("lang")).agg(F.count_if(answers.needs_rewrite("text")).alias("rewritten"), F.count("*").alias("texts"))


def text_summaries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(answers.summary("text", 300)).alias("size"), F.md5(answers.summary("text", 300)).alias("digest"))


def score_parse(spark: SparkSession, d: str) -> DataFrame:
    """The first number of each text, as a score."""
    return table(spark, d, "documents").select("doc_id", F.round(answers.score_in("text"), 6).alias("score"))


def recall_overall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of each document's confirmed tags among its pending ones, with the overall score of the measures that are known."""
    s = table(spark, d, "tag_suggestions").select(norm_key("doc_id").alias("doc"), norm_key("tag_name").alias("t"), norm_key("status").alias("s")).where("doc IS NOT NULL AND t IS NOT NULL")
    of = lambda x: F.collect_set(F.when(F.col("s") == x, F.col("t")))
    g = s.groupBy("doc").agg(of("pending").alias("got"), of("confirmed").alias("wanted"))
    g = g.withColumn("context_recall", F.round(measures.context_recall(F.col("got"), F.col("wanted")), 6)).withColumn("context_precision", F.when(F.size("got") > 0, F.size(F.array_intersect("got", "wanted")) / F.size("got")))
    none = F.lit(None).cast("double")
    g = g.withColumns({"relevance": none, "reciprocal_rank": none, "ndcg": none})
    return g.select("doc", "context_recall", measures.overall().alias("overall"))


def graded_gain(spark: SparkSession, d: str) -> DataFrame:
    """nDCG at 5 of each source's suggestions by their id, the confidence being the gain."""
    s = table(spark, d, "tag_suggestions").dropDuplicates(["id"]).where("confidence BETWEEN 0 AND 1").select(norm_key("doc_id").alias("query"), "id", F.col("confidence").alias("score")).where("query IS NOT NULL")
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("id")))
    return measures.graded_ndcg(r, 5)


def audit_session(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audit_log").dropDuplicates(["id"]).withColumn("ms", F.col("duration_ms").cast("double")).withColumn("memory", F.length("details").cast("double"))
    return measures.session_summary(a, "operation", "ms", "memory")


def audit_search_profile(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audit_log").dropDuplicates(["id"]).where("operation = 'search'")
    return measures.search_profile(a, "duration_ms", "duration_ms")


def report_change(spark: SparkSession, d: str) -> DataFrame:
    """The last month's audit figures against those of the latest other month."""
    a = table(spark, d, "audit_log").dropDuplicates(["id"]).where("ts IS NOT NULL")
    m = a.groupBy(F.date_format("ts", "yyyy-MM").alias("report")).agg(F.max("ts").alias("at"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"), F.count("*").cast("double").alias("operations"))
    last = m.agg(F.max("report")).first()[0]  # one value
    return measures.report_change(m, last or "", "report", "at", ["mean_ms", "operations"])


def health_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The state of the store from its operations: an operation of which over a tenth failed is an error, over a twentieth a warning."""
    a = table(spark, d, "audit_log").dropDuplicates(["id"]).groupBy(F.col("operation").alias("name")).agg(F.avg((F.col("result") == "failed").cast("double")).alias("f"), F.max("duration_ms").alias("latency_ms"))
    return measures.health(a.withColumn("status", F.when(F.col("f") > 0.1, "error").when(F.col("f") > 0.05, "warning").otherwise("ok")))


def entities_typed(spark: SparkSession, d: str) -> DataFrame:
    """Entities by type, with how often they are named."""
    e = entities.extract(chunks(spark, d), "vector_id", "content", keep=["document_id"])
    return e.groupBy("name", "type").agg(F.count("*").alias("chunks"), F.count_distinct(norm_key("document_id")).alias("documents"))


def _counted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "tag_suggestions").dropDuplicates(["id"]).select("id", norm_key("doc_id").alias("doc"), norm_key("tag_name").alias("name"), norm_key("source").alias("type")).where("name IS NOT NULL")
    return entities.counters(s.select("name", "type", F.col("id").alias("at"))), s


def entity_counters(spark: SparkSession, d: str) -> DataFrame:
    """Tags as entities that were added one by one."""
    return _counted(spark, d)[0]


def entity_search(spark: SparkSession, d: str) -> DataFrame:
    return entities.search(_counted(spark, d)[0], "Quin", 20).select("name", "doc_count")


def entity_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    counted, s = _counted(spark, d)
    edges = s.select("doc", "name").where("doc IS NOT NULL").distinct().groupBy("name").agg(F.count("*").alias("n"))
    return entities.graph_statistics(counted, edges, s, "doc")


def keywords_diverse(spark: SparkSession, d: str) -> DataFrame:
    """Three keywords of each document by maximal marginal relevance."""
    return entities.keywords(table(spark, d, "documents").dropDuplicates(["doc_id"]), "doc_id", "text", 3)


def pii_mask_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Spans of personal data by type, no two of which overlap."""
    found = table(spark, d, "documents").select(F.explode(pii.detect("text")).alias("s")).select("s.*")
    return found.groupBy("entity_type").agg(F.count("*").alias("spans"), F.sum(F.col("stop") - F.col("start")).alias("characters"))


def pipeline_changes(spark: SparkSession, d: str) -> DataFrame:
    """What normalisation by settings changes in each text; the word list is the 20 000 most frequent words of documents."""
    from docweave.functions.text import tokens

    words = table(spark, d, "documents").select(F.explode(tokens("text")).alias("w")).where("length(w) > 1").groupBy("w").count()
    known = {r[0] for r in words.orderBy(F.desc("count"), "w").limit(20_000).collect()}  # the word list, a parameter of bounded size
    rows = table(spark, d, "normalisation_results").dropDuplicates(["result_id"])
    done = cleanup.normalise_rows(rows, table(spark, d, "normalisation_settings"), known)
    return done.select("result_id", F.array_join("normalised.changes_made", ",").alias("changes"), "normalised.original_length", "normalised.normalised_length")


def content_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs by label."""
    b = table(spark, d, "documents").select(F.explode(cleanup.blocks_column("text")).alias("b"))
    return b.groupBy("b.type").agg(F.count("*").alias("blocks"), F.sum("b.length").alias("characters"))


def page_order(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of made-up pages, from the vectors' first values, in reading order."""
    v = table(spark, d, "embeddings").where("size(embedding) >= 4").select(F.col("vec_id").alias("block"), (F.col("vec_id") % 50).alias("page"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(2)])
    b = v.select("block", "page", F.round(F.abs("e0") * 400, 2).alias("x0"), F.round(F.abs("e0") * 400 + 20, 2).alias("x1"), F.round(F.abs("e1") * 700, 2).alias("y0"), F.col("block").cast("string").alias("text"), F.lit(200.0).alias("width"))
    return layout.reading_order(layout.column_of(b, ["page"], "width"), ["page"]).select("page", "block", "column", "columns", "position")


def model_inference(spark: SparkSession, d: str) -> DataFrame:
    """Model names as they stand in suggestions, with what a name says."""
    names = table(spark, d, "tag_suggestions").select(norm_key("source_model").alias("model")).where("model IS NOT NULL").groupBy("model").agg(F.count("*").alias("uses"))
    i = engines.inferred("model")
    return names.select("model", "uses", i["type"].alias("type"), i["memory_gb"].alias("memory_gb"))


_N = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13))), '')"
_V = "(SELECT DISTINCT ON (vector_id) * FROM vector_metadata)"
_SUG = "(SELECT DISTINCT ON (id) * FROM tag_suggestions)"
_AUD = "(SELECT DISTINCT ON (id) * FROM audit_log)"
_R = f"""r AS (SELECT *, document_id || '.txt' AS filename, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT vector_id AS id, {_N.format("document_id")} AS document_id, content, batch_no AS page, round(100.0::DOUBLE / length(content), 6) AS score FROM {_V} WHERE content LIKE '%archive%' ORDER BY score DESC, id LIMIT 60)),
g AS (SELECT *, coalesce(document_id, 'row ' || rank) AS doc_group, min(rank) OVER (PARTITION BY coalesce(document_id, 'row ' || rank)) AS f FROM r), gp AS (SELECT *, dense_rank() OVER (ORDER BY f, doc_group) AS group_position FROM g)"""
_CNT = f"s AS (SELECT id, {_N.format('doc_id')} AS doc, {_N.format('tag_name')} AS name, {_N.format('source')} AS type FROM {_SUG} WHERE {_N.format('tag_name')} IS NOT NULL), c AS (SELECT name, arg_min(type, id) AS type, count(*) AS doc_count, count(*) AS chunk_count FROM s GROUP BY 1)"
_ENT = " UNION ALL ".join(f"SELECT vector_id, document_id, {i} AS o, '{k}' AS type, lower(unnest(regexp_extract_all(content, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])({"|".join(entities._escaped(n) for n in entities.NAMES[k][1])})(?:$|[^\\p{{L}}\\p{{N}}_])', 1))) AS name FROM {_V}" for i, k in enumerate(entities.ORDER))

QUERIES = {
    "context_groups": context_groups,
    "context_citations": context_citations,
    "context_relevant": context_relevant,
    "citations_distinct": citations_distinct,
    "questions_rewritten": questions_rewritten,
    "text_summaries": text_summaries,
    "score_parse": score_parse,
    "recall_overall": recall_overall,
    "graded_gain": graded_gain,
    "audit_session": audit_session,
    "audit_search_profile": audit_search_profile,
    "report_change": report_change,
    "health_rollup": health_rollup,
    "entities_typed": entities_typed,
    "entity_counters": entity_counters,
    "entity_search": entity_search,
    "entity_graph_stats": entity_graph_stats,
    "keywords_diverse": keywords_diverse,
    "pii_spans": pii_mask_sizes,
    "pipeline_changes": pipeline_changes,
    "content_blocks": content_blocks,
    "page_order": page_order,
    "model_inference": model_inference,
}
SQL = {
    "context_groups": f"WITH {_R} SELECT id, CAST(rank AS INTEGER) AS rank, doc_group, CAST(group_position AS INTEGER) AS group_position FROM gp",
    "context_citations": f"WITH {_R} SELECT CAST(group_position AS INTEGER) AS group_position, arg_min(id, rank) AS id, max(score) AS score, coalesce(array_to_string(list_sort(list(DISTINCT page) FILTER (page IS NOT NULL)), ','), '') AS pages, count(*) AS chunks FROM gp GROUP BY 1",
    "context_relevant": f"WITH {_R} SELECT id, score FROM r WHERE score >= 0.6 ORDER BY score DESC, id LIMIT 10",
    "citations_distinct": f"WITH {_R} SELECT filename, page, id FROM r QUALIFY row_number() OVER (PARTITION BY filename, page ORDER BY score DESC, id) = 1",
    "questions_rewritten": f"SELECT {_N.format('lang')} AS lang, count(*) FILTER (regexp_matches(lower(text), '{answers.INDICATORS}')) AS rewritten, count(*) AS texts FROM documents GROUP BY 1",
    "text_summaries": """WITH t AS (SELECT doc_id, trim(text) AS t FROM documents), u AS (SELECT doc_id, t, regexp_extract(t[1:300], '(?s)^(.*[.!?])', 1) AS w FROM t)
SELECT doc_id, CAST(length(x) AS INTEGER) AS size, md5(x) AS digest FROM (SELECT doc_id, CASE WHEN length(t) <= 300 THEN t WHEN length(w) >= 240 THEN w ELSE rtrim(t[1:297]) || '...' END AS x FROM u)""",
    "score_parse": r"SELECT doc_id, CASE WHEN x IS NOT NULL THEN round(least(1.0, greatest(0.0, x)), 6) END AS score FROM (SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '(-?[0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS x FROM documents)",
    "recall_overall": f"""WITH s AS (SELECT {_N.format("doc_id")} AS doc, {_N.format("tag_name")} AS t, {_N.format("status")} AS st FROM tag_suggestions), g AS (SELECT doc, coalesce(list(DISTINCT t) FILTER (st = 'pending'), []) AS got, coalesce(list(DISTINCT t) FILTER (st = 'confirmed'), []) AS wanted FROM s WHERE doc IS NOT NULL AND t IS NOT NULL GROUP BY 1),
m AS (SELECT doc, round(CASE WHEN len(wanted) = 0 THEN 1.0 ELSE len(list_intersect(got, wanted)) / len(wanted)::DOUBLE END, 6) AS r, CASE WHEN len(got) > 0 THEN len(list_intersect(got, wanted)) / len(got)::DOUBLE END AS p FROM g)
SELECT doc, r AS context_recall, round((coalesce(p, 0) * 0.3::DOUBLE + r * 0.2::DOUBLE) / CASE WHEN p IS NULL THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END, 6) AS overall FROM m""",
    "graded_gain": f"""WITH s AS (SELECT {_N.format("doc_id")} AS query, id, confidence AS score FROM {_SUG} WHERE confidence BETWEEN 0 AND 1), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY id) AS rank FROM s WHERE query IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank) AS b FROM r)
SELECT query, round(CASE WHEN i > 0 THEN d / i ELSE 0 END, 6) AS ndcg FROM (SELECT query, sum(CASE WHEN rank <= 5 THEN score / log2(rank + 1) ELSE 0 END) AS d, sum(CASE WHEN b <= 5 THEN score / log2(b + 1) ELSE 0 END) AS i FROM b GROUP BY 1)""",
    "audit_session": f"""SELECT operation, count(*) AS count, round(sum(ms), 6) AS total_ms, round(avg(ms), 6) AS mean_ms, min(ms) AS min_ms, max(ms) AS max_ms, round(median(ms), 6) AS median_ms, round(coalesce(stddev_samp(ms), 0), 6) AS stdev_ms, round(avg(memory), 6) AS mean_memory, max(memory) AS max_memory
FROM (SELECT operation, duration_ms::DOUBLE AS ms, length(details)::DOUBLE AS memory FROM {_AUD}) WHERE ms IS NOT NULL GROUP BY 1""",
    "audit_search_profile": f"SELECT count(duration_ms) AS searches, round(count(duration_ms) / sum(duration_ms)::DOUBLE * 1000, 6) AS per_second, round(avg(duration_ms), 6) AS mean_results FROM {_AUD} WHERE operation = 'search'",
    "report_change": f"""WITH m AS (SELECT strftime(ts, '%Y-%m') AS report, max(ts) AS latest, round(avg(duration_ms), 6) AS mean_ms, count(*)::DOUBLE AS operations FROM {_AUD} WHERE ts IS NOT NULL GROUP BY 1), c AS (SELECT * FROM m ORDER BY report DESC LIMIT 1), p AS (SELECT * FROM m WHERE report <> (SELECT report FROM c) ORDER BY latest DESC, report DESC LIMIT 1)
SELECT 'mean_ms' AS metric, c.mean_ms AS current, p.mean_ms AS previous, round(c.mean_ms - p.mean_ms, 6) AS change FROM c, p UNION ALL SELECT 'operations', c.operations, p.operations, round(c.operations - p.operations, 6) FROM c, p""",
    "health_rollup": f"""WITH a AS (SELECT operation, avg((result = 'failed')::INT) AS f, max(duration_ms) AS l FROM {_AUD} GROUP BY 1), s AS (SELECT CASE WHEN f > 0.1 THEN 'error' WHEN f > 0.05 THEN 'warning' ELSE 'ok' END AS s, l FROM a)
SELECT CASE WHEN count(*) FILTER (s = 'error') > 0 THEN 'error' WHEN count(*) FILTER (s = 'warning') > 0 THEN 'warning' ELSE 'ok' END AS status, count(*) AS checks, count(*) FILTER (s = 'error') AS errors, count(*) FILTER (s = 'warning') AS warnings, max(l) AS slowest_ms FROM s""",
    "entities_typed": f"""WITH e AS ({_ENT}), b AS (SELECT vector_id, document_id, name, arg_min(type, o) AS type FROM e GROUP BY 1, 2, 3) SELECT name, type, count(*) AS chunks, count(DISTINCT {_N.format("document_id")}) AS documents FROM b GROUP BY 1, 2""",
    "entity_counters": f"WITH {_CNT} SELECT * FROM c",
    "entity_search": f"WITH {_CNT} SELECT name, doc_count FROM c WHERE lower(name) LIKE '%quin%' ORDER BY doc_count DESC, name LIMIT 20",
    "entity_graph_stats": f"""WITH {_CNT} SELECT 'total' AS kind, 'entities' AS name, count(*) AS n FROM c UNION ALL SELECT 'total', 'edges', count(DISTINCT name) FROM s WHERE doc IS NOT NULL UNION ALL SELECT 'total', 'mentions', count(*) FROM s
UNION ALL SELECT 'total', 'documents', count(DISTINCT doc) FROM s UNION ALL SELECT 'type', type, count(*) FROM c GROUP BY type""",
    "model_inference": f"""SELECT model, count(*) AS uses, CASE WHEN regexp_matches(model, '{engines.TYPES["embedding"]}') THEN 'embedding' WHEN regexp_matches(model, '{engines.TYPES["vision"]}') THEN 'vision' WHEN regexp_matches(model, '{engines.TYPES["reranker"]}') THEN 'reranker' WHEN regexp_matches(model, '{engines.TYPES["code"]}') THEN 'code' ELSE 'chat' END AS type, NULL::DOUBLE AS memory_gb
FROM (SELECT {_N.format("source_model")} AS model FROM tag_suggestions) WHERE model IS NOT NULL GROUP BY 1""",
    "page_order": """WITH b AS (SELECT vec_id AS block, vec_id % 50 AS page, round(abs(embedding[1]::DOUBLE) * 400, 2) AS x0, round(abs(embedding[1]::DOUBLE) * 400 + 20, 2) AS x1, round(abs(embedding[2]::DOUBLE) * 700, 2) AS y0 FROM embeddings WHERE len(embedding) >= 4),
c AS (SELECT *, coalesce(((x0 + x1) / 2 - lag((x0 + x1) / 2) OVER w > 60)::INT, 0) AS fresh FROM b WINDOW w AS (PARTITION BY page ORDER BY (x0 + x1) / 2, y0)), e AS (SELECT *, least(2, sum(fresh) OVER (PARTITION BY page ORDER BY (x0 + x1) / 2, y0 ROWS UNBOUNDED PRECEDING)) AS col FROM c)
SELECT page, block, CAST(col AS INTEGER) AS "column", CAST(max(col) OVER (PARTITION BY page) + 1 AS INTEGER) AS columns, CAST(row_number() OVER (PARTITION BY page ORDER BY col, y0, x0, block::VARCHAR) AS INTEGER) AS position FROM e""",
}
