"""Keyword, vector and hybrid queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.text import tokens
from docweave.operators import querylang, search
from docweave.session import table

TERMS = ["archive", "query", "index"]
DIM = 64
#: A fixed query vector.
QUERY = [round(((i * 37) % 64 - 31.5) / 32, 6) for i in range(DIM)]


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.top(search.bm25(table(spark, d, "documents"), "doc_id", "text", TERMS), 30)


def bm25_restricted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return search.top(search.bm25(docs, "doc_id", "text", TERMS, docs.where("lang = 'en'")), 30)


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    p = search.postings(table(spark, d, "documents"), "doc_id", "text")
    return p.agg(F.countDistinct("term").alias("terms"), F.sum("tf").alias("tokens"), F.count("*").alias("postings"), F.countDistinct("id").alias("documents"))


def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    p = search.postings(table(spark, d, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


BOOLEAN = {
    "and": "archive AND query",
    "or": "snapshot OR glossary",
    "not": "archive NOT query",
    "prefix": "archiv* AND index*",
    "phrase": '"audit trail" OR "query planner"',
    "grouped": '(snapshot OR invoices) "audit trail" NOT glossary',
}


def boolean_query(name: str, spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", tokens("text").alias("toks"))
    return docs.where(querylang.predicate(querylang.parse(BOOLEAN[name]), "toks")).select("doc_id")


def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return search.knn_cosine(table(spark, d, "embeddings"), "vec_id", "embedding", QUERY, 20)


def knn_cosine_unclamped(spark: SparkSession, d: str) -> DataFrame:
    return search.knn_cosine(table(spark, d, "embeddings"), "vec_id", "embedding", QUERY, 20, unclamped=True)


def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return search.knn_l2(table(spark, d, "embeddings"), "vec_id", "embedding", QUERY, 20)


def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return search.knn_cosine(table(spark, d, "embeddings").where("label = 3"), "vec_id", "embedding", QUERY, 10)


def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 20, against all."""
    v = table(spark, d, "embeddings")
    return search.knn_batch(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 5, DIM).select("query_id", "id", "score", "rank")


def get_by_ids_ordered(spark: SparkSession, d: str) -> DataFrame:
    """A list of ids in its order; missing ones give a null row."""
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(x).cast("bigint") for x in (7, 3, 10**9, 7, 0)])).alias("pos", "id"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return wanted.join(v, "id", "left").select(F.col("pos").cast("int").alias("pos"), "id", "label")


def pool_mean(spark: SparkSession, d: str) -> DataFrame:
    """The length-1 mean vector of each label, as (label, dim, value)."""
    v = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    means = v.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    length = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label")))
    return means.select("label", F.col("dim").cast("int").alias("dim"), F.round(F.col("m") / length, 6).alias("value"))


def vector_stats(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "chunk_embeddings")
    return v.agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("chunks"), F.count_if(F.col("embedding").isNull()).alias("missing"), F.count_if(F.size("embedding") == DIM).alias("usable"), F.max(F.size("embedding")).alias("dim"))


def _lists(spark: SparkSession, d: str, n: int = 30) -> tuple[DataFrame, DataFrame]:
    semantic = search.knn_cosine(table(spark, d, "embeddings"), "vec_id", "embedding", QUERY, n)
    keyword = search.top(search.bm25(table(spark, d, "documents"), "doc_id", "text", TERMS), n)
    return semantic, keyword


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return search.rrf(list(_lists(spark, d)))


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.hybrid(*_lists(spark, d), 10).drop("semantic_rank", "keyword_rank")


def hybrid_boosted(spark: SparkSession, d: str) -> DataFrame:
    boosts = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), F.lit(0.4).alias("boost"))
    return search.hybrid(*_lists(spark, d), 10, boosts).select("id", "rrf_score", "combined_score", "rank")


def keyword_only(spark: SparkSession, d: str) -> DataFrame:
    k = search.top(search.bm25(table(spark, d, "documents"), "doc_id", "text", TERMS), 10)
    return k.select("id", F.round(F.least(F.lit(1.0), F.col("score") / 10), 6).alias("score"), "rank").where("score >= 0.2")


def decompose(how: str, spark: SparkSession, d: str) -> DataFrame:
    """Results of two sub-queries merged by id: the largest score, the sum, or weights 1 / (position + 1) over the number of lists."""
    lists = [search.top(search.bm25(table(spark, d, "documents"), "doc_id", "text", q), 20).select("id", "score", F.lit(i).alias("part")) for i, q in enumerate((["snapshot", "glossary"], ["query", "planner"]))]
    both = lists[0].unionByName(lists[1])
    if how == "weighted":
        place = F.row_number().over(Window.partitionBy("id").orderBy("part"))
        both = both.withColumn("score", F.col("score") / place)
        return both.groupBy("id").agg(F.round(F.sum("score") / F.count("*"), 6).alias("score"))
    return both.groupBy("id").agg(F.round(F.max("score") if how == "max" else F.sum("score"), 6).alias("score"))


def rerank(spark: SparkSession, d: str) -> DataFrame:
    """The keyword list re-scored by the share of query terms present, original and final rank kept."""
    base = search.top(search.bm25(table(spark, d, "documents"), "doc_id", "text", TERMS), 20).withColumnRenamed("rank", "original_rank")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), tokens("text").alias("toks"))
    share = F.size(F.array_intersect("toks", F.array(*[F.lit(t) for t in TERMS]))) / len(TERMS)
    scored = base.join(docs, "id").select("id", "original_rank", F.round(share, 6).alias("rerank_score"))
    final = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("rerank_score"), "original_rank"))
    return scored.withColumn("final_rank", final).where("rerank_score >= 0.3")


_TOKS = r"list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _bm25_sql(terms: list[str], cte: str = "bm", only: str = "true") -> str:
    quoted = ", ".join(f"'{t}'" for t in sorted(set(terms)))
    return f"""
{cte}_docs AS (SELECT doc_id AS id, lang, {_TOKS} AS toks FROM documents WHERE text IS NOT NULL),
{cte}_tf AS (SELECT id, lang, len(toks) AS len, t.term, len(list_filter(toks, lambda x: x = t.term)) AS tf FROM {cte}_docs, (SELECT unnest([{quoted}]) AS term) t),
{cte}_stats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM {cte}_docs),
{cte}_df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM {cte}_tf GROUP BY term),
{cte} AS (
  SELECT id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
         * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avgdl))), 6) AS score
  FROM {cte}_tf JOIN {cte}_df USING (term), {cte}_stats WHERE {only} GROUP BY id HAVING sum(tf) > 0)"""


def _top_sql(cte: str, k: int) -> str:
    return f"(SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM {cte} ORDER BY score DESC, id LIMIT {k})"


_Q = "[" + ", ".join(map(str, QUERY)) + "]::DOUBLE[]"
_COS = f"list_cosine_similarity(embedding::DOUBLE[], {_Q})"
_CLAMP = f"round(greatest(0.0, least(1.0, 1 - (1 - {_COS}) / 2)), 6)"
_KNN = f"knn AS (SELECT vec_id AS id, {_CLAMP} AS score FROM embeddings)"
_BM = _bm25_sql(TERMS)
_BOTH = f"""
WITH {_BM}, {_KNN}, s AS {_top_sql("knn", 30)}, w AS {_top_sql("bm", 30)},
fused AS (SELECT coalesce(s.id, w.id) AS id, s.score AS semantic_score, w.score AS bm25_score,
  round(coalesce(1.0 / (60 + s.rank), 0) + coalesce(1.0 / (60 + w.rank), 0), 6) AS rrf_score,
  round(0.7 * coalesce(s.score, 0) + 0.3 * coalesce(least(1.0, w.score / 10), 0), 6) AS combined_score
  FROM s FULL OUTER JOIN w ON s.id = w.id),
best AS (SELECT * FROM fused ORDER BY rrf_score DESC, id LIMIT 10)"""
_DEC = f"""WITH {_bm25_sql(["snapshot", "glossary"], "p0")}, {_bm25_sql(["query", "planner"], "p1")},
parts AS (SELECT id, score, 0 AS part FROM {_top_sql("p0", 20)} UNION ALL SELECT id, score, 1 FROM {_top_sql("p1", 20)})"""


def _has(w: str) -> str:
    return f"list_contains(toks, '{w}')"


def _phrase(w: str) -> str:
    return f"contains(' ' || array_to_string(toks, ' ') || ' ', ' {w} ')"


def _prefix(w: str) -> str:
    return f"len(list_filter(toks, lambda x: starts_with(x, '{w}'))) > 0"


_BOOL_SQL = {
    "and": f"{_has('archive')} AND {_has('query')}",
    "or": f"{_has('snapshot')} OR {_has('glossary')}",
    "not": f"{_has('archive')} AND NOT {_has('query')}",
    "prefix": f"{_prefix('archiv')} AND {_prefix('index')}",
    "phrase": f"{_phrase('audit trail')} OR {_phrase('query planner')}",
    "grouped": f"({_has('snapshot')} OR {_has('invoices')}) AND {_phrase('audit trail')} AND NOT {_has('glossary')}",
}

QUERIES = {
    "bm25_topk": bm25_topk,
    "bm25_restricted_docs": bm25_restricted,
    "index_stats": index_stats,
    "term_statistics": term_statistics,
    **{f"boolean_{n}": partial(boolean_query, n) for n in BOOLEAN},
    "knn_cosine": knn_cosine,
    "knn_cosine_unclamped": knn_cosine_unclamped,
    "knn_l2": knn_l2,
    "knn_filtered": knn_filtered,
    "knn_batch": knn_batch,
    "get_by_ids_ordered": get_by_ids_ordered,
    "late_pool_mean": pool_mean,
    "vector_stats": vector_stats,
    "rrf_fuse": rrf_fuse,
    "hybrid_topk": hybrid_topk,
    "hybrid_boosted": hybrid_boosted,
    "keyword_only": keyword_only,
    **{f"decompose_aggregate_{h}": partial(decompose, h) for h in ("max", "sum", "weighted")},
    "rerank_with_ranks": rerank,
}
SQL = {
    "bm25_topk": f"WITH {_BM} SELECT * FROM {_top_sql('bm', 30)}",
    "bm25_restricted_docs": f"WITH {_bm25_sql(TERMS, only=chr(34) + 'lang' + chr(34) + ' = ' + chr(39) + 'en' + chr(39))} SELECT * FROM {_top_sql('bm', 30)}",
    "index_stats": f"""WITH t AS (SELECT doc_id, unnest({_TOKS}) AS term FROM documents), p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL)
SELECT count(DISTINCT term) AS terms, CAST(sum(tf) AS BIGINT) AS tokens, count(*) AS postings, count(DISTINCT doc_id) AS documents FROM p""",
    "term_statistics": f"""WITH t AS (SELECT doc_id, unnest({_TOKS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term""",
    **{f"boolean_{n}": f"WITH t AS (SELECT doc_id, {_TOKS} AS toks FROM documents) SELECT doc_id FROM t WHERE {c}" for n, c in _BOOL_SQL.items()},
    "knn_cosine": f"WITH {_KNN} SELECT * FROM {_top_sql('knn', 20)}",
    "knn_cosine_unclamped": f"WITH knn AS (SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings) SELECT * FROM {_top_sql('knn', 20)}",
    "knn_l2": f"WITH knn AS (SELECT vec_id AS id, round(1 / (1 + list_sum([(a.x - a.y) * (a.x - a.y) for a in list_transform(list_zip(embedding::DOUBLE[], {_Q}), lambda z: {{'x': z[1], 'y': z[2]}})])), 6) AS score FROM embeddings) SELECT * FROM {_top_sql('knn', 20)}",
    "knn_filtered": f"WITH knn AS (SELECT vec_id AS id, {_CLAMP} AS score FROM embeddings WHERE label = 3) SELECT * FROM {_top_sql('knn', 10)}",
    "knn_batch": """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM p QUALIFY rank <= 5""",
    "get_by_ids_ordered": "SELECT CAST(w.pos AS INTEGER) AS pos, CAST(w.id AS BIGINT) AS id, label FROM (SELECT unnest(range(5)) AS pos, unnest([7, 3, 1000000000, 7, 0]) AS id) w LEFT JOIN embeddings ON vec_id = w.id",
    "late_pool_mean": """WITH e AS (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS dim FROM embeddings), m AS (SELECT label, dim, avg(x::DOUBLE) AS m FROM e GROUP BY ALL)
SELECT label, CAST(dim AS INTEGER) AS dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM m""",
    "vector_stats": "SELECT count(*) AS n, count(DISTINCT chunk_id) AS chunks, count(*) FILTER (embedding IS NULL) AS missing, count(*) FILTER (len(embedding) = 64) AS usable, CAST(max(len(embedding)) AS INTEGER) AS dim FROM chunk_embeddings",
    "rrf_fuse": f"WITH {_BM}, {_KNN}, u AS (SELECT * FROM {_top_sql('knn', 30)} UNION ALL SELECT * FROM {_top_sql('bm', 30)}) SELECT id, round(sum(1.0 / (60 + rank)), 6) AS rrf_score FROM u GROUP BY id",
    "hybrid_topk": _BOTH + " SELECT id, semantic_score, bm25_score, rrf_score, combined_score, CAST(row_number() OVER (ORDER BY rrf_score DESC, id) AS INTEGER) AS rank FROM best",
    "hybrid_boosted": _BOTH
    + """, b AS (SELECT best.id, round(rrf_score * f, 6) AS rrf_score, round(combined_score * f, 6) AS combined_score FROM
(SELECT best.*, CASE WHEN d.lang = 'en' THEN 1.2 ELSE 1.0 END AS f FROM best LEFT JOIN documents d ON d.doc_id = best.id) best)
SELECT id, rrf_score, combined_score, CAST(row_number() OVER (ORDER BY combined_score DESC, id) AS INTEGER) AS rank FROM b""",
    "keyword_only": f"WITH {_BM} SELECT id, round(least(1.0, score / 10), 6) AS score, rank FROM {_top_sql('bm', 10)} WHERE round(least(1.0, score / 10), 6) >= 0.2",
    "decompose_aggregate_max": _DEC + " SELECT id, round(max(score), 6) AS score FROM parts GROUP BY id",
    "decompose_aggregate_sum": _DEC + " SELECT id, round(sum(score), 6) AS score FROM parts GROUP BY id",
    "decompose_aggregate_weighted": _DEC + ", r AS (SELECT id, score / row_number() OVER (PARTITION BY id ORDER BY part) AS s FROM parts) SELECT id, round(sum(s) / count(*), 6) AS score FROM r GROUP BY id",
    "rerank_with_ranks": f"""WITH {_BM}, k AS {_top_sql("bm", 20)}, r AS (SELECT k.id, k.rank AS original_rank, round(({" + ".join(f"CAST(list_contains(toks, '{t}') AS INT)" for t in TERMS)}) / 3.0, 6) AS rerank_score FROM k JOIN bm_docs USING (id))
SELECT *, CAST(row_number() OVER (ORDER BY rerank_score DESC, original_rank) AS INTEGER) AS final_rank FROM r QUALIFY rerank_score >= 0.3""",
}
