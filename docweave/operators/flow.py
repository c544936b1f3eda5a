"""Documents from files to search in one flow, searches by mode, evaluation of searches, and the records these leave."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import chunks as chunking
from docweave.functions import text as texts
from docweave.operators import engines
from docweave.operators.documents import ChangeLog, DocumentStore
from docweave.operators.keyindex import KeywordIndex
from docweave.operators.search import hybrid, knn_cosine, rrf
from docweave.sources.files import discover, extract_files, failure

AUDIT = "operation string, target string, result string, duration_ms bigint, at timestamp"
REASONS = ("missing", "symlink", "unsupported", "indexed", "duplicate")


def skip_reasons(files: DataFrame, known_ids: DataFrame, known_hashes: DataFrame) -> DataFrame:
    """files (path, there, symlink, file_type, document_id, content_hash) with reasons: why each would not be indexed, in the order of REASONS; empty if it would."""
    ids = known_ids.select("document_id", F.lit(True).alias("__id")).distinct()
    hashes = known_hashes.where("content_hash IS NOT NULL").select("content_hash", F.lit(True).alias("__hash")).distinct()
    j = files.join(ids, "document_id", "left").join(hashes, "content_hash", "left")
    tests = (~F.coalesce("there", F.lit(False)), F.col("symlink"), F.coalesce("file_type", F.lit("unknown")) == "unknown", F.col("__id"), F.col("__hash"))
    found = F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(r)) for t, r in zip(tests, REASONS)])
    return j.withColumn("reasons", F.filter(found, lambda x: x.isNotNull())).drop("__id", "__hash")


def plan_totals(plan: DataFrame, action: str = "action") -> DataFrame:
    """(action, documents) of a dry run, the whole as total."""
    n = plan.groupBy(F.col(action).alias("action")).agg(F.count("*").alias("documents"))
    return n.unionByName(plan.agg(F.lit("total").alias("action"), F.count("*").alias("documents")))


def repair_plan(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, action, chunks): chunks of no document to delete, and documents without a chunk to index again."""
    d = documents.select("document_id").where("document_id IS NOT NULL").distinct()
    c = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    orphans = c.join(d, "document_id", "left_anti").select("document_id", F.lit("delete_chunks").alias("action"), "chunks")
    return orphans.unionByName(d.join(c.where("document_id IS NOT NULL"), "document_id", "left_anti").select("document_id", F.lit("index_again").alias("action"), F.lit(0).cast("bigint").alias("chunks")))


def index_path(spark: SparkSession, folder: str, store: DocumentStore, index: KeywordIndex | None = None, embedder: Callable[[], engines.Embedder] | None = None, strategy: str = "sentence", size: int = 512, overlap: int = 50, least: int = 100, extractors: dict | None = None, skip_duplicates: bool = True) -> DataFrame:
    """Indexes the files of a folder; (path, document_id, status, chunks, reason) of each: indexed, skipped or failed.

    Texts are cleaned, cut by the strategy, embedded, and added to the store and the keyword index, each document in place of what is
    there of it. A file whose content another document of the store or an earlier file has is skipped. One Spark job over all files.
    """
    files = extract_files(discover(spark, folder), extractors).withColumn("text", texts.universal_fixes("text"))
    f = files.select("path", "file_type", F.col("length").alias("file_size"), "text", "error", texts.document_id("path").alias("document_id"), texts.content_hash("text").alias("content_hash"))
    why = failure(F.col("text"), F.col("error"), least=1)
    held = store.documents.live().select("content_hash", F.col("document_id").alias("__holder")).where("content_hash IS NOT NULL").dropDuplicates(["content_hash"])
    f = f.withColumn("reason", why).join(held, "content_hash", "left")
    first = F.row_number().over(Window.partitionBy("content_hash").orderBy("path"))
    twice = F.lit(skip_duplicates) & F.col("content_hash").isNotNull() & ((F.col("__holder").isNotNull() & (F.col("__holder") != F.col("document_id"))) | (first > 1))
    f = f.withColumn("status", F.when(F.col("reason").isNotNull(), "failed").when(twice, "skipped").otherwise("indexed"))
    f = f.withColumn("reason", F.when(F.col("status") == "skipped", "duplicate").otherwise(F.col("reason")))
    # written once: the store and the index are filled from it
    done = ChangeLog(spark, f"{store.folder}/runs", "path string, document_id string, file_type string, file_size bigint, content_hash string, status string, reason string, text string", "path")
    done.put(f.drop("__holder", "error"))
    f = done.live().where("path IS NOT NULL")
    taken = f.where("status = 'indexed'")
    cut = taken.select("document_id", F.explode(chunking.chunk_column("text", strategy, size, overlap, least)).alias("c")).select("document_id", F.col("c.index").alias("position"), F.col("c.content").alias("content"))
    if embedder is not None:
        cut = cut.withColumn("embedding", engines.embedded("content", embedder))
    documents = taken.select("document_id", "path", F.regexp_replace("path", "^.*/", "").alias("filename"), "file_type", "file_size", "content_hash", F.current_timestamp().alias("indexed_at"))
    store.add(documents, cut)
    if index is not None:
        index.add(store.held_chunks().join(taken.select("document_id"), "document_id", "left_semi"), "document_id", "chunk_id", "content")
    counts = store.documents.live().select("document_id", "chunk_count")
    return f.join(counts, "document_id", "left").select("path", "document_id", "status", F.when(F.col("status") == "indexed", F.coalesce("chunk_count", F.lit(0))).otherwise(F.lit(0)).alias("chunks"), "reason")


def results_summary(results: DataFrame) -> DataFrame:
    """(status, reason, documents, chunks) of index_path()."""
    return results.groupBy("status", "reason").agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"))


class Searcher:
    """Keyword, semantic and hybrid search over a store and its index, by mode.

    Filters (a condition on chunks) narrow the semantic side before its limit; tags narrow the results after the limit. A blank query finds
    nothing. Results are (id, score, rank) with document_id; of hybrid search with the scores of both sides.
    """

    def __init__(self, store: DocumentStore, index: KeywordIndex, embedder: Callable[[], engines.Embedder]):
        self.store, self.index, self.embedder = store, index, embedder

    def _empty(self) -> DataFrame:
        return self.store.spark.createDataFrame([], "id string, score double, rank int, document_id string")

    def _owner(self, found: DataFrame) -> DataFrame:
        return found.join(self.store.held_chunks().select(F.col("chunk_id").alias("id"), "document_id"), "id")

    def semantic(self, query: str, limit: int, where: Column | None = None) -> DataFrame:
        vector = self.embedder().embed([query])[0]
        rows = self.store.held_chunks().where("embedding IS NOT NULL")
        return knn_cosine(rows if where is None else rows.where(where), "chunk_id", "embedding", vector, limit)

    def keyword(self, query: str, limit: int) -> DataFrame:
        return self.index.search(query, limit).select(F.col("chunk").alias("id"), "score", "rank")

    def search(self, query: str, mode: str = "hybrid", limit: int = 10, min_score: float = 0.0, where: Column | None = None, documents: DataFrame | None = None, boosts: DataFrame | None = None) -> DataFrame:
        """documents: (document_id) of those that results are kept to, after the limit. ValueError for an unknown mode."""
        if mode not in ("semantic", "keyword", "hybrid"):
            raise ValueError(f"unknown mode {mode}")
        if not query.strip():
            return self._empty()
        if mode == "semantic":
            found = self.semantic(query, limit, where).where(F.col("score") >= min_score)
        elif mode == "keyword":
            found = self.keyword(query, limit).withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") / 10), 6)).where(F.col("score") >= min_score)
        else:
            found = hybrid(self.semantic(query, limit * 3, where), self.keyword(query, limit * 3), limit, boosts, min_score or None)
        found = self._owner(found)
        return found if documents is None else found.join(documents.select("document_id").distinct(), "document_id", "left_semi")

    def evaluate(self, cases: list[tuple[str, list[str]]], limit: int = 15) -> DataFrame:
        """(query, precision, recall, reciprocal_rank) of searches against the documents each is to find; recall is 1 where none is expected."""
        spark, out = self.store.spark, None
        for query, expected in cases:
            found = self.search(query, "hybrid", limit).groupBy("document_id").agg(F.min("rank").alias("rank"))
            wanted = spark.createDataFrame([(e,) for e in expected], "document_id string").distinct().withColumn("hit", F.lit(1))
            j = found.join(wanted, "document_id", "left").agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("h"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
            size = len(set(expected))
            one = j.select(F.lit(query).alias("query"), F.round(F.when(F.col("n") > 0, F.col("h") / F.col("n")).otherwise(0.0), 6).alias("precision"), F.round(F.lit(1.0) if not size else F.col("h") / size, 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"))
            out = one if out is None else out.unionByName(one)
        return out


def fused(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """rrf() of ranked lists, ranked."""
    r = rrf(lists, k)
    return r.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("rrf_score"), "id")))  # results of one query


@contextmanager
def audited(spark: SparkSession, folder: str, operation: str, target: str) -> Iterator[dict]:
    """Appends an audit row for what is done inside: success, partial (set result["partial"]) or failed with the time it took; the error goes on."""
    began, result, state = time.perf_counter(), {}, "success"
    try:
        yield result
        state = "partial" if result.get("partial") else "success"
    except BaseException:
        state = "failed"
        raise
    finally:
        took = int((time.perf_counter() - began) * 1000)
        spark.createDataFrame([(operation, target, state, took)], "operation string, target string, result string, duration_ms bigint").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(folder)


def write_json_lines(rows: DataFrame, folder: str) -> None:
    """Appends rows as JSON lines: structured logs, chat histories, evaluations."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(folder)


def _json_lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The lines of a folder that are JSON, in a column r, with the time their file was changed in changed."""
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_modification_time").alias("changed"))
    return lines.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("r"), "changed")


def read_sessions(spark: SparkSession, folder: str, schema: str, order: str = "created_at") -> DataFrame:
    """What write_json_lines() wrote, the newest first; lines that cannot be read are left out."""
    return _json_lines(spark, folder, schema).select("r.*").orderBy(F.desc_nulls_last(order))


def read_recent(spark: SparkSession, folder: str, schema: str, days: int) -> DataFrame:
    """The rows of JSON files that were changed in the last days; lines that cannot be read are left out."""
    rows = _json_lines(spark, folder, schema)
    return rows.where(F.col("changed") >= F.current_timestamp() - F.make_dt_interval(F.lit(days))).select("r.*")


def reader_view(title: Column, author: Column, source: Column, text: Column) -> Column:
    """A plain HTML page of a text: title, author and source in the head, paragraphs below; what is null is left out."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = lambda tag, c: F.coalesce(F.concat(F.lit(f"<{tag}>"), safe(c), F.lit(f"</{tag}>\n")), F.lit(""))
    body = F.array_join(F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), "\n\\s*\n"), lambda p: F.btrim(p) != ""), lambda p: F.concat(F.lit("<p>"), safe(F.btrim(p)), F.lit("</p>"))), "\n")
    return F.concat(F.lit("<!DOCTYPE html>\n<html><head><meta charset=\"utf-8\">\n"), line("title", title), F.lit("</head><body>\n"), line("h1", title), line("p", author), line("p", source), body, F.lit("\n</body></html>"))
