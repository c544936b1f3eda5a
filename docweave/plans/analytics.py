"""Duplicates, sets, histograms, latencies, evaluation measures, context packing, entities and their graph."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.keys import norm_key
from docweave.operators import evaluation, graph
from docweave.session import table


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL AND text <> ''")
    return docs.select("doc_id", F.sha2("text", 256).alias("hash"), F.length("text").alias("size"))


def dedup_groups(spark: SparkSession, d: str) -> DataFrame:
    """Texts that several documents have: how many, and the first."""
    return _hashed(spark, d).groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("original")).where("copies > 1")


def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return _hashed(spark, d).groupBy("hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def dedup_link(spark: SparkSession, d: str) -> DataFrame:
    """Every copy with its original. The originals are a join and not a window, so a text with many copies stays spread."""
    h = _hashed(spark, d)
    first = h.groupBy("hash").agg(F.min("doc_id").alias("original"), F.count("*").alias("n")).where("n > 1")
    return h.join(first, "hash").where("doc_id <> original").select(F.col("doc_id").alias("duplicate"), "original")


def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    """Documents by batch order: the first state of each record against the last, as new, changed or same."""
    r = table(spark, d, "document_records").dropDuplicates(["record_id"]).select(norm_key("document_id").alias("doc"), "batch_no", "record_id", "file_size")
    old = r.where("batch_no <= 20").groupBy("doc").agg(F.max_by("file_size", F.struct("batch_no", "record_id")).alias("old"), F.lit(True).alias("in_old"))
    new = r.where("batch_no > 20").groupBy("doc").agg(F.max_by("file_size", F.struct("batch_no", "record_id")).alias("new"), F.lit(True).alias("in_new"))
    kind = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "missing").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return old.join(new, "doc", "full_outer").select("doc", kind.alias("change"))


def ids_without_vector(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vector_metadata").select("chunk_id").distinct().join(table(spark, d, "chunk_embeddings").select("chunk_id"), "chunk_id", "left_anti")


def ids_with_vector(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vector_metadata").select("chunk_id").distinct().join(table(spark, d, "chunk_embeddings").select("chunk_id"), "chunk_id", "left_semi")


def orphan_lines(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each batch whose document has no record."""
    known = table(spark, d, "document_records").select(norm_key("document_id").alias("doc")).where("doc IS NOT NULL").distinct()
    v = table(spark, d, "vector_metadata").dropDuplicates(["vector_id"]).select("batch_no", norm_key("document_id").alias("doc"))
    return v.join(known, "doc", "left_anti").groupBy("batch_no").agg(F.count("*").alias("orphans"))


def file_types(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "document_records").dropDuplicates(["record_id"])
    kind = F.upper(F.coalesce(norm_key("file_type"), F.lit("unknown")))
    return r.groupBy(kind.alias("file_type")).agg(F.count("*").alias("records"), F.count_distinct(norm_key("document_id")).alias("documents"), F.sum("chunk_count").alias("chunks"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy("doc_type").agg(F.count("*").alias("documents"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.min("ingested_at").alias("first"), F.max("ingested_at").alias("last"))


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean, deviation and interpolated percentiles of durations an operation; deviation is 0 for one sample."""
    a = table(spark, d, "audit_log").dropDuplicates(["id"]).where("duration_ms IS NOT NULL")
    p = [F.round(F.percentile("duration_ms", F.lit(x)), 4).alias(f"p{int(x * 100)}") for x in (0.5, 0.95, 0.99)]
    sd = F.round(F.coalesce(F.stddev_samp("duration_ms"), F.lit(0.0)), 4).alias("stdev_ms")
    per_s = F.round(1000.0 * F.count("*") / F.nullif(F.sum("duration_ms"), F.lit(0)), 6).alias("per_second")
    return a.groupBy("operation").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 4).alias("mean_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"), sd, per_s, *p)


def percentile_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles, sorted[int(n p)]: by rank counts of distinct values, not by one list of all values."""
    a = table(spark, d, "audit_log").dropDuplicates(["id"]).where("duration_ms IS NOT NULL").groupBy("operation", "duration_ms").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("operation").orderBy("duration_ms"))
    n = F.sum("c").over(Window.partitionBy("operation"))
    r = a.select("operation", "duration_ms", upto.alias("upto"), n.alias("n"))
    rank = lambda p: F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    return r.groupBy("operation").agg(*[F.min(F.when(F.col("upto") > rank(p), F.col("duration_ms"))).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)])


def histogram(spark: SparkSession, d: str) -> DataFrame:
    """Ten equal buckets between the smallest and the largest event value, empty ones too."""
    return evaluation.histogram(table(spark, d, "events").where("value IS NOT NULL"), "value", 10)


def profile_compare(spark: SparkSession, d: str) -> DataFrame:
    """Mean value of each event type before and after the middle of January: regression, improvement, stable, new or removed."""
    e = table(spark, d, "events")
    halves = [e.where(c).groupBy("event_type").agg(F.avg("value").alias(n)) for c, n in (("ts < '2024-01-16'", "base"), ("ts >= '2024-01-16'", "current"))]
    return evaluation.compare(halves[0], halves[1], "event_type")


def compare_backends(spark: SparkSession, d: str) -> DataFrame:
    """Mean and throughput a result of operations, and which is the fastest."""
    a = table(spark, d, "audit_log").dropDuplicates(["id"]).where("duration_ms IS NOT NULL")
    m = a.groupBy("operation", "result").agg(F.avg("duration_ms").alias("mean"))
    return m.groupBy("operation").agg(F.min_by("result", F.struct("mean", "result")).alias("fastest"), F.round(F.min("mean"), 4).alias("mean_ms"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """(query, rank, score, relevant): each user's events by value as a ranking, purchases being relevant."""
    e = table(spark, d, "events").where("value IS NOT NULL AND user_id IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return e.select(F.col("user_id").alias("query"), rank.alias("rank"), F.col("value").alias("score"), (F.col("event_type") == "purchase").alias("relevant"))


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.retrieval_metrics(_ranked(spark, d), 10)


def retrieval_summary(spark: SparkSession, d: str) -> DataFrame:
    m = evaluation.retrieval_metrics(_ranked(spark, d), 10)
    return m.agg(*[F.round(F.avg(c), 5).alias(c) for c in ("precision", "recall", "reciprocal_rank", "average_precision", "ndcg")])


def relevance_decay(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.decayed_mean(_ranked(spark, d), 0.9)


def context_precision(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).groupBy("query").agg(F.round(F.avg((F.col("score") >= 50).cast("double")), 6).alias("precision"))


def context_pack(spark: SparkSession, d: str) -> DataFrame:
    """The best documents of each source, by age, while their lengths fit 4000 characters; it stops at the first that does not."""
    docs = table(spark, d, "documents").where("text IS NOT NULL AND text <> ''").select(F.coalesce(norm_key("source"), F.lit("")).alias("source"), "doc_id", F.length("text").alias("size"))
    return evaluation.pack(docs, "source", "doc_id", "size", 4000)


def history_recent(spark: SparkSession, d: str) -> DataFrame:
    """The last three events of each user."""
    e = table(spark, d, "events").where("user_id IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return e.withColumn("place", place).where("place <= 3").select("user_id", "event_id", "place")


def history_budget(spark: SparkSession, d: str) -> DataFrame:
    """The latest chunks of each document that fit 1000 tokens in all, at least one."""
    v = table(spark, d, "vector_metadata").dropDuplicates(["vector_id"]).where("content IS NOT NULL").select(norm_key("document_id").alias("doc"), "vector_id", F.floor(F.length("content") / 4).alias("size"))
    w = Window.partitionBy("doc").orderBy(F.desc("vector_id"))
    run = v.where("doc IS NOT NULL").withColumns({"sum": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(w)})
    return run.where("sum <= 1000 OR place = 1").select("doc", "vector_id", "place")


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    """How a window of 4096 tokens is shared by history and context for each user, from the characters of history."""
    e = table(spark, d, "events").where("user_id IS NOT NULL").groupBy("user_id").agg((F.count("*") * 40).alias("chars"))
    available = 4096 - 1024
    history = F.greatest(F.lit(256), F.least(F.floor(F.col("chars") / 4), F.lit(int(0.3 * available))))
    return e.select("user_id", history.cast("bigint").alias("history_tokens"), (available - history).cast("bigint").alias("context_tokens"))


def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    return graph.mentions(table(spark, d, "vector_metadata").dropDuplicates(["vector_id"]), "vector_id", "content")


def entity_stats(spark: SparkSession, d: str) -> DataFrame:
    m = graph.mentions(table(spark, d, "vector_metadata").dropDuplicates(["vector_id"]), "vector_id", "content", ["document_id"])
    return m.groupBy("entity").agg(F.count("*").alias("chunks"), F.count_distinct(norm_key("document_id")).alias("documents"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(entity_mentions(spark, d))


def graph_related(spark: SparkSession, d: str) -> DataFrame:
    return graph.related(graph.edges(entity_mentions(spark, d)), "audit trail", 2)


def entity_documents(spark: SparkSession, d: str) -> DataFrame:
    m = graph.mentions(table(spark, d, "vector_metadata").dropDuplicates(["vector_id"]), "vector_id", "content", ["document_id"])
    return m.where("entity = 'audit trail'").select(norm_key("document_id").alias("document")).where("document IS NOT NULL").distinct()


_SH = "h AS (SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL AND text <> '')"
_N = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13))), '')"
_AUD = "(SELECT DISTINCT ON (id) * FROM audit_log)"
_REC = "(SELECT DISTINCT ON (record_id) * FROM document_records)"
_VEC = "(SELECT DISTINCT ON (vector_id) * FROM vector_metadata)"
_RANK = "r AS (SELECT user_id AS query, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, value AS score, event_type = 'purchase' AS relevant FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL)"
_METRICS = f"""WITH {_RANK}, rel AS (SELECT *, sum(CAST(relevant AS INT)) OVER (PARTITION BY query ORDER BY rank) AS found, sum(CAST(relevant AS INT)) OVER (PARTITION BY query) AS total FROM r),
m AS (SELECT query, round(count(*) FILTER (relevant AND rank <= 10) / 10.0, 6) AS precision,
  round(coalesce(count(*) FILTER (relevant AND rank <= 10) / nullif(max(total), 0)::DOUBLE, 0), 6) AS recall, round(coalesce(1.0 / min(rank) FILTER (relevant), 0), 6) AS reciprocal_rank,
  round(coalesce(sum(found::DOUBLE / rank) FILTER (relevant) / nullif(max(total), 0), 0), 6) AS average_precision,
  round(coalesce(sum(1 / log2(rank + 1)) FILTER (relevant AND rank <= 10) / nullif(list_sum([1 / log2(i + 1) for i in range(1, least(max(total), 10)::BIGINT + 1)]), 0), 0), 6) AS ndcg FROM rel GROUP BY query)"""
_ENT = "(" + " UNION ALL ".join(f"SELECT '{e}' AS entity" for e in graph.VOCABULARY) + ")"
_MEN = f"men AS (SELECT vector_id, document_id, entity FROM {_VEC} v, {_ENT} e WHERE contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> ''), ' ') || ' ', ' ' || entity || ' '))"
_EDG = f"{_MEN}, edg AS (SELECT a.entity AS source, b.entity AS target, count(*) AS n, least(1.0, 1.0 + 0.1 * (count(*) - 1)) AS weight FROM men a JOIN men b ON a.vector_id = b.vector_id AND a.entity < b.entity GROUP BY 1, 2)"

QUERIES = {
    "exact_dedup_groups": dedup_groups,
    "dedup_keep_first": dedup_keep_first,
    "dedup_link": dedup_link,
    "incremental_diff": incremental_diff,
    "set_difference_ids": ids_without_vector,
    "set_intersect_ids": ids_with_vector,
    "orphan_check": orphan_lines,
    "file_type_histogram": file_types,
    "corpus_stats": corpus_stats,
    "latency_summary": latency_summary,
    "percentile_nearest": percentile_nearest,
    "latency_histogram": histogram,
    "profile_compare": profile_compare,
    "compare_backends": compare_backends,
    "retrieval_metrics": retrieval_metrics,
    "retrieval_summary": retrieval_summary,
    "relevance_decay": relevance_decay,
    "context_precision": context_precision,
    "context_pack": context_pack,
    "history_recent": history_recent,
    "history_budget": history_budget,
    "token_budget": token_budget,
    "entity_mentions": entity_mentions,
    "entity_stats": entity_stats,
    "graph_edges": graph_edges,
    "graph_related_2hop": graph_related,
    "entity_documents": entity_documents,
}
SQL = {
    "exact_dedup_groups": f"WITH {_SH} SELECT hash, count(*) AS copies, min(doc_id) AS original FROM h GROUP BY hash HAVING count(*) > 1",
    "dedup_keep_first": f"WITH {_SH} SELECT min(doc_id) AS doc_id FROM h GROUP BY hash",
    "dedup_link": f"WITH {_SH}, w AS (SELECT doc_id AS duplicate, min(doc_id) OVER (PARTITION BY hash) AS original FROM h) SELECT * FROM w WHERE duplicate <> original",
    "incremental_diff": f"""WITH r AS (SELECT {_N.format("document_id")} AS doc, batch_no, record_id, file_size FROM {_REC}),
o AS (SELECT doc, file_size AS old, true AS in_old FROM r WHERE batch_no <= 20 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY batch_no DESC, record_id DESC) = 1),
n AS (SELECT doc, file_size AS new, true AS in_new FROM r WHERE batch_no > 20 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY batch_no DESC, record_id DESC) = 1)
SELECT coalesce(o.doc, n.doc) AS doc, CASE WHEN in_old IS NULL THEN 'new' WHEN in_new IS NULL THEN 'missing' WHEN old IS NOT DISTINCT FROM new THEN 'same' ELSE 'changed' END AS change FROM o FULL OUTER JOIN n ON o.doc = n.doc""",
    "set_difference_ids": "SELECT chunk_id FROM vector_metadata EXCEPT SELECT chunk_id FROM chunk_embeddings",
    "set_intersect_ids": "SELECT chunk_id FROM vector_metadata INTERSECT SELECT chunk_id FROM chunk_embeddings",
    "orphan_check": f"SELECT batch_no, count(*) AS orphans FROM (SELECT DISTINCT ON (vector_id) batch_no, {_N.format('document_id')} AS doc FROM vector_metadata) v LEFT JOIN (SELECT DISTINCT {_N.format('document_id')} AS id FROM document_records) r ON r.id = v.doc WHERE r.id IS NULL GROUP BY 1",
    "file_type_histogram": f"SELECT upper(coalesce({_N.format('file_type')}, 'unknown')) AS file_type, count(*) AS records, count(DISTINCT {_N.format('document_id')}) AS documents, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM {_REC} GROUP BY 1",
    "corpus_stats": 'SELECT doc_type, count(*) AS documents, round(avg(length(text)), 4) AS mean_chars, min(ingested_at) AS "first", max(ingested_at) AS "last" FROM documents GROUP BY 1',
    "latency_summary": f"""SELECT operation, count(*) AS n, round(avg(duration_ms), 4) AS mean_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, round(coalesce(stddev_samp(duration_ms), 0), 4) AS stdev_ms,
 round(1000.0 * count(*) / nullif(sum(duration_ms), 0)::DOUBLE, 6) AS per_second, round(quantile_cont(duration_ms, 0.5), 4) AS p50, round(quantile_cont(duration_ms, 0.95), 4) AS p95, round(quantile_cont(duration_ms, 0.99), 4) AS p99
 FROM {_AUD} WHERE duration_ms IS NOT NULL GROUP BY 1""",
    "percentile_nearest": f"""WITH l AS (SELECT operation, list_sort(list(duration_ms)) AS x, count(*) AS n FROM {_AUD} WHERE duration_ms IS NOT NULL GROUP BY 1)
SELECT operation, x[CAST(least(floor(n * 0.5), n - 1) AS BIGINT) + 1] AS p50, x[CAST(least(floor(n * 0.95), n - 1) AS BIGINT) + 1] AS p95, x[CAST(least(floor(n * 0.99), n - 1) AS BIGINT) + 1] AS p99 FROM l""",
    "latency_histogram": """WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events), k AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bucket FROM events, b WHERE value IS NOT NULL)
SELECT CAST(r.bucket AS INTEGER) AS bucket, count(k.bucket) AS n FROM (SELECT unnest(range(10)) AS bucket) r LEFT JOIN k ON k.bucket = r.bucket GROUP BY 1""",
    "profile_compare": """WITH a AS (SELECT event_type, avg(value) AS base FROM events WHERE ts < '2024-01-16' GROUP BY 1), c AS (SELECT event_type, avg(value) AS current FROM events WHERE ts >= '2024-01-16' GROUP BY 1),
j AS (SELECT coalesce(a.event_type, c.event_type) AS event_type, base, current, 100 * (current - base) / nullif(base, 0) AS p FROM a FULL OUTER JOIN c ON a.event_type = c.event_type)
SELECT event_type, round(current - base, 6) AS delta, round(p, 4) AS percent, CASE WHEN base IS NULL OR base = 0 THEN 'new' WHEN current IS NULL THEN 'removed' WHEN p > 5 THEN 'regression' WHEN p < -5 THEN 'improvement' ELSE 'stable' END AS status FROM j""",
    "compare_backends": f"WITH m AS (SELECT operation, result, avg(duration_ms) AS mean FROM {_AUD} WHERE duration_ms IS NOT NULL GROUP BY 1, 2) SELECT operation, arg_min(result, mean) AS fastest, round(min(mean), 4) AS mean_ms FROM m GROUP BY 1",
    "retrieval_metrics": _METRICS + " SELECT * FROM m",
    "retrieval_summary": _METRICS + " SELECT round(avg(precision), 5) AS precision, round(avg(recall), 5) AS recall, round(avg(reciprocal_rank), 5) AS reciprocal_rank, round(avg(average_precision), 5) AS average_precision, round(avg(ndcg), 5) AS ndcg FROM m",
    "relevance_decay": f"WITH {_RANK} SELECT query, round(sum(score * pow(0.9, rank - 1)) / sum(pow(0.9, rank - 1)), 6) AS relevance FROM r GROUP BY query",
    "context_precision": f"WITH {_RANK} SELECT query, round(avg(CASE WHEN score >= 50 THEN 1.0 ELSE 0.0 END), 6) AS precision FROM r GROUP BY query",
    "context_pack": f"""WITH p AS (SELECT coalesce({_N.format("source")}, '') AS source, doc_id, length(text) AS size FROM documents WHERE text IS NOT NULL AND text <> ''),
q AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM p) SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM q WHERE used <= 4000""",
    "history_recent": "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM events WHERE user_id IS NOT NULL QUALIFY place <= 3",
    "history_budget": f"""WITH v AS (SELECT {_N.format("document_id")} AS doc, vector_id, length(content) // 4 AS size FROM {_VEC} WHERE content IS NOT NULL),
q AS (SELECT doc, vector_id, sum(size) OVER (PARTITION BY doc ORDER BY vector_id DESC) AS used, CAST(row_number() OVER (PARTITION BY doc ORDER BY vector_id DESC) AS INTEGER) AS place FROM v WHERE doc IS NOT NULL)
SELECT doc, vector_id, place FROM q WHERE used <= 1000 OR place = 1""",
    "token_budget": "WITH e AS (SELECT user_id, count(*) * 40 AS chars FROM events WHERE user_id IS NOT NULL GROUP BY 1) SELECT user_id, greatest(256, least(chars // 4, 921)) AS history_tokens, 3072 - greatest(256, least(chars // 4, 921)) AS context_tokens FROM e",
    "entity_mentions": f"WITH {_MEN} SELECT vector_id, entity FROM men",
    "entity_stats": f"WITH {_MEN} SELECT entity, count(*) AS chunks, count(DISTINCT {_N.format('document_id')}) AS documents FROM men GROUP BY 1",
    "graph_edges": f"WITH {_EDG} SELECT * FROM edg",
    "graph_related_2hop": f"""WITH {_EDG}, bi AS (SELECT source, target, weight FROM edg UNION ALL SELECT target, source, weight FROM edg),
h1 AS (SELECT target AS entity, max(0.7 * weight) AS score FROM bi WHERE source = 'audit trail' GROUP BY 1),
h2 AS (SELECT b.target AS entity, max(h1.score * b.weight * 0.49) AS score FROM h1 JOIN bi b ON b.source = h1.entity WHERE b.target <> 'audit trail' AND b.target NOT IN (SELECT entity FROM h1) GROUP BY 1)
SELECT entity, 1 AS hops, round(score, 6) AS score FROM h1 UNION ALL SELECT entity, 2, round(score, 6) FROM h2""",
    "entity_documents": f"WITH {_MEN} SELECT DISTINCT {_N.format('document_id')} AS document FROM men WHERE entity = 'audit trail' AND {_N.format('document_id')} IS NOT NULL",
}
