"""Problem 1: tag suggestions, chunks and namespace values that point to nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.keys import iso_instant, month, norm_key
from docweave.operators.orphans import orphan_references, report_by_period
from docweave.session import table


def deletions(audit: DataFrame) -> DataFrame:
    """(key, deleted_at): the latest delete of each target that took place; dry runs and failures did not."""
    dry = F.coalesce(F.lower(F.col("details")).rlike(r'"dry_run"\s*:\s*"?true'), F.lit(False))
    took_place = (norm_key("operation") == "delete") & (norm_key("result") == "success") & ~dry
    return audit.where(took_place).groupBy(norm_key("target").alias("key")).agg(F.max(F.col("ts").cast("timestamp")).alias("deleted_at"))


def documents_alive(records: DataFrame, audit: DataFrame) -> DataFrame:
    """(key, born, dead) a document: earliest indexed_at, and the latest delete if it is later than the latest indexed_at."""
    times = records.select(norm_key("document_id").alias("key"), iso_instant("indexed_at").alias("at"))
    spans = times.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("at").alias("born"), F.max("at").alias("last"))
    gone = F.when(F.col("deleted_at") > F.col("last"), F.col("deleted_at"))
    return spans.join(deletions(audit), "key", "left").select("key", "born", gone.alias("dead"))


def all_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, row_key, created_month, orphan_reason), one row per row key."""
    documents = documents_alive(table(spark, sf_dir, "document_records"), table(spark, sf_dir, "audit_log"))
    namespaces = table(spark, sf_dir, "tag_namespaces").select(norm_key("name").alias("key"), F.col("created_at").cast("timestamp").alias("born"))
    sources = (
        ("tag_suggestions", "id", "doc_id", documents, "dead"),
        ("vector_metadata", "vector_id", "document_id", documents, "dead"),
        ("tag_namespace_values", "tag_value", "namespace", namespaces, None),
    )
    found = None
    for name, key, ref, target, dead in sources:
        rows = table(spark, sf_dir, name).select(F.col(key).cast("string").alias("row_key"), norm_key(ref).alias("ref"), F.col("created_at"))
        one = orphan_references(rows, ["ref"], target, ["key"], spread="row_key", born="born", dead=dead, at=F.col("created_at"))
        one = one.select(F.lit(name).alias("table_name"), "row_key", month("created_at").alias("created_month"), "orphan_reason")
        found = one if found is None else found.unionByName(one)
    return found.dropDuplicates(["table_name", "row_key"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose reference matches nothing, a deleted document, or only rows of a later month."""
    return all_orphans(spark, sf_dir).select("table_name", "row_key", "created_month")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, month and reason."""
    return report_by_period(all_orphans(spark, sf_dir), "table_name", "created_month").select("table_name", F.col("period").alias("created_month"), "orphan_reason", "orphans")


_TRIM = "lower(trim({}, ' ' || chr(9) || chr(10) || chr(13)))"
_ORPHANS = f"""
WITH recs AS (
  SELECT {_TRIM.format("document_id")} AS key,
         CASE WHEN regexp_matches(indexed_at, '([zZ]|[+-][0-9][0-9]:?[0-9][0-9])$') THEN TRY_CAST(indexed_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC'
              ELSE TRY_CAST(indexed_at AS TIMESTAMP) END AS seen_at
  FROM document_records),
docs AS (SELECT key, min(seen_at) AS born, max(seen_at) AS last FROM recs WHERE key <> '' GROUP BY key),
dels AS (
  SELECT {_TRIM.format("target")} AS key, max(ts) AS deleted_at FROM audit_log
  WHERE {_TRIM.format("operation")} = 'delete' AND {_TRIM.format("result")} = 'success'
    AND NOT coalesce(regexp_matches(lower(details), '"dry_run"\\s*:\\s*"?true'), false)
  GROUP BY 1),
targets AS (
  SELECT 'd' AS kind, docs.key, born, coalesce(deleted_at > last, false) AS gone FROM docs LEFT JOIN dels ON docs.key = dels.key
  UNION ALL
  SELECT 'n', {_TRIM.format("name")}, min(created_at), false FROM tag_namespaces GROUP BY 2),
refs AS (
  SELECT 'tag_suggestions' AS table_name, 'd' AS kind, CAST(id AS VARCHAR) AS row_key, {_TRIM.format("doc_id")} AS ref, created_at FROM tag_suggestions
  UNION ALL SELECT 'vector_metadata', 'd', CAST(vector_id AS VARCHAR), {_TRIM.format("document_id")}, created_at FROM vector_metadata
  UNION ALL SELECT 'tag_namespace_values', 'n', tag_value, {_TRIM.format("namespace")}, created_at FROM tag_namespace_values),
found AS (
  SELECT DISTINCT table_name, row_key, strftime(created_at, '%Y-%m') AS created_month,
    CASE WHEN t.key IS NULL THEN 'absent' WHEN t.gone THEN 'deleted' ELSE 'later' END AS orphan_reason
  FROM refs r LEFT JOIN targets t ON t.kind = r.kind AND t.key = r.ref
  WHERE r.ref <> '' AND (t.key IS NULL OR t.gone OR date_trunc('month', t.born) > date_trunc('month', r.created_at)))
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL = {
    "p1_found": _ORPHANS + "SELECT table_name, row_key, created_month FROM found",
    "p1_report": _ORPHANS + "SELECT table_name, created_month, orphan_reason, count(*) AS orphans FROM found GROUP BY 1, 2, 3",
}
