"""Keyword, vector and hybrid search.

The inverted index is a table of postings (term, id, tf, len) that can be written bucketed by term and read again; a
query touches the postings of its terms only, which prunes the scan to their row groups when the table is sorted by term.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.text import NO_WORD, folded, tokens

K1, B, RRF_K = 1.2, 0.75, 60
SEMANTIC_WEIGHT, KEYWORD_WEIGHT, BM25_SCALE = 0.7, 0.3, 10.0


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, id, tf, len): the inverted index. Null and empty texts have no posting; rows sharing a key are counted apart before the sum."""
    toks = docs.select(F.col(key).alias("id"), tokens(text).alias("__t")).withColumn("len", F.size("__t"))
    return toks.select("id", "len", F.explode("__t").alias("term")).groupBy("term", "id", "len").agg(F.count("*").alias("tf")).select("term", "id", "tf", "len")


def _occurrences(part: str) -> Column:
    return (F.length("__s") - F.length(F.replace(F.col("__s"), F.lit(part), F.lit("")))) / len(part)


def bm25(docs: DataFrame, key: str, text: str, query: list[str], only: DataFrame | None = None) -> DataFrame:
    """(id, score) of every document with a query term, higher being better; score is rounded to 6 places.

    Statistics (number of documents with a text, document frequency, mean length) are over all of docs even where
    only (a table with the key) restricts the results. idf is ln((N - n + 0.5) / (n + 0.5)), at least 1e-6. Terms of
    the query that repeat count once. Texts are read once: lengths and term counts come from one pass.
    """
    terms = sorted(set(query))
    # tokens parted by two blanks, so that each is found with its own blanks around it: string functions instead of arrays
    spaced = F.concat(F.lit(" "), F.btrim(F.regexp_replace(folded(text), NO_WORD, "  ")), F.lit(" "))
    counted = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), spaced.alias("__s"))
    size = F.when(F.length("__s") > 2, _occurrences("  ") + 1).otherwise(F.lit(0)).cast("int").alias("len")
    tf = [_occurrences(f" {q} ").cast("int").alias(f"tf{i}") for i, q in enumerate(terms)]
    counted = counted.select("id", size, *tf)
    # one row of statistics
    stats = counted.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hit = counted.where(" OR ".join(f"tf{i} > 0" for i in range(len(terms))) or "false")
    if only is not None:
        hit = hit.join(only.select(F.col(key).alias("id")).distinct(), "id", "left_semi")
    joined = hit.join(F.broadcast(stats))  # a single row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("n_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        weight = F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
        score = score + F.when(idf > 0, idf).otherwise(F.lit(1e-6)) * weight
    return joined.select("id", F.round(score, 6).alias("score"))


def top(scored: DataFrame, k: int, score: str = "score", key: str = "id", rank: str = "rank") -> DataFrame:
    """The k best rows with their rank from 1; ties go to the smaller key."""
    best = scored.orderBy(F.desc(score), F.asc(key)).limit(k)
    return best.withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(score), F.asc(key))))


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(v: str, query: list[float]) -> Column:
    """Cosine similarity to a fixed vector; null for vectors of another length, with nulls, or of no length."""
    q = F.array(*[F.lit(float(x)) for x in query])
    size = math.sqrt(sum(float(x) ** 2 for x in query))
    length = F.sqrt(dot(F.col(v), F.col(v)))
    return F.when((F.size(v) == len(query)) & (length > 0), dot(F.col(v), q) / (length * F.lit(size)))


def knn_cosine(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, unclamped: bool = False) -> DataFrame:
    """(id, score, rank): the k nearest by cosine. score is 1 - d / 2 within [0, 1] for the cosine distance d, or 1 - d if unclamped."""
    c = cosine(vector, query)
    # greatest and least pass over nulls, so vectors without a cosine are left out first
    score = c if unclamped else F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (1 - c) / 2)))
    scored = vectors.select(F.col(key).alias("id"), F.round(score, 6).alias("score")).where(F.col("score").isNotNull())
    return top(scored, k)


def knn_l2(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """(id, score, rank): the k nearest by Euclidean distance; score is 1 / (1 + d^2)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    square = F.aggregate(F.zip_with(F.col(vector), q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    scored = vectors.where(F.size(vector) == len(query)).select(F.col(key).alias("id"), F.round(1 / (1 + square), 6).alias("score")).where(F.col("score").isNotNull())
    return top(scored, k)


def knn_batch(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, dim: int, block: int = 2048) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of each query vector by cosine, the query itself aside.

    Blocks of about block vectors meet blocks of as many queries, both cut by hash into parts that the counts give, so that a
    packed row has a bounded size whatever the tables'. Each pair of blocks is one matrix product that keeps k rows a
    query, and the partial results are merged by a window. Queries are a stated set.
    """
    fine = lambda df: df.where((F.size(vector) == dim) & F.exists(vector, lambda x: x != 0)).select(F.col(key).cast("bigint").alias("id"), _doubles(F.col(vector)).alias("v"))
    parts, blocks = (max(1, -(-df.count() // block)) for df in (queries, vectors))
    left = fine(queries).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(parts)))
    packed_q = left.groupBy("qb").agg(F.collect_list(F.struct("id", "v")).alias("q"))

    def unpack(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        return rows.field(0).to_numpy(zero_copy_only=False), rows.field(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, float]] = []
            for i in range(b.num_rows):
                (ids, m), (names, q) = (unpack(b.column(c).slice(i, 1).flatten()) for c in (0, 1))
                near = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T, 6)
                near[names[:, None] == ids[None, :]] = -2
                for name, row in zip(names.tolist(), near):
                    # all that reach the k-th best, so that ties are settled by id
                    least = np.partition(row, -k)[-k] if len(row) > k else -1.5
                    at = np.flatnonzero(row >= max(least, -1.5))
                    at = at[np.lexsort((ids[at], -row[at]))][:k]
                    out += zip([name] * len(at), ids[at].tolist(), row[at].tolist())
            a, c, d = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "id", "score"])

    right = fine(vectors).withColumn("vb", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    packed_v = right.groupBy("vb").agg(F.collect_list(F.struct("id", "v")).alias("m"))
    met = packed_v.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(packed_q, "qb")
    partial = met.select("m", "q").mapInArrow(run, "query_id bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k)


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(id, rrf_score): reciprocal rank fusion of ranked lists (id, rank), rounded to 6 places."""
    union = None
    for x in lists:
        one = x.select("id", "rank")
        union = one if union is None else union.unionByName(one)
    return union.groupBy("id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 6).alias("rrf_score"))


def hybrid(semantic: DataFrame, keyword: DataFrame, limit: int, boosts: DataFrame | None = None, min_score: float | None = None) -> DataFrame:
    """The fused ranking of a semantic and a keyword list (id, score, rank).

    combined is 0.7 x semantic + 0.3 x min(1, bm25 / 10), a missing side adding 0. The limit best by rrf_score are kept;
    boosts (id, boost) multiply both scores by 1 + boost / 2 and re-sort by combined. A row is dropped under min_score only if
    both scores are. Ties go to the smaller id.
    """
    s = semantic.select("id", F.col("score").alias("semantic_score"), F.col("rank").alias("semantic_rank"))
    w = keyword.select("id", F.col("score").alias("bm25_score"), F.col("rank").alias("keyword_rank"))
    both = s.join(w, "id", "full_outer")
    part = lambda rank: F.coalesce(1.0 / (F.lit(RRF_K) + F.col(rank)), F.lit(0.0))
    combined = SEMANTIC_WEIGHT * F.coalesce("semantic_score", F.lit(0.0)) + KEYWORD_WEIGHT * F.coalesce(F.least(F.lit(1.0), F.col("bm25_score") / BM25_SCALE), F.lit(0.0))
    both = both.withColumn("rrf_score", F.round(part("semantic_rank") + part("keyword_rank"), 6)).withColumn("combined_score", F.round(combined, 6))
    out = top(both, limit, "rrf_score", rank="rank")
    if boosts is not None:
        factor = 1 + 0.5 * F.coalesce("boost", F.lit(0.0))
        out = out.drop("rank").join(boosts.select("id", "boost"), "id", "left")
        out = out.withColumn("rrf_score", F.round(F.col("rrf_score") * factor, 6)).withColumn("combined_score", F.round(F.col("combined_score") * factor, 6)).drop("boost")
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("combined_score"), "id")))
    if min_score is not None:
        out = out.where((F.col("combined_score") >= min_score) | (F.col("rrf_score") >= min_score))
    return out
