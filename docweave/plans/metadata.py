"""Metadata filters, the audit log, tags, collections, namespaces, suggestions, tiers."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.keys import norm_key
from docweave.operators import tagging
from docweave.operators.filters import compile_filter, tag_query
from docweave.plans.collections_tree import latest_collections
from docweave.session import table

COLUMNS = ("vector_id", "chunk_id", "document_id", "content")
FILTERS = {
    "filter_json_eq": {"page": 2},
    "filter_json_in": {"strategy": {"$in": ["fixed", "structure"]}},
    "filter_json_nin_empty": {"strategy": {"$nin": []}},
    "filter_json_ne": {"strategy": {"$ne": "sentence"}},
    "filter_json_and_or": {"$or": [{"page": {"$gt": 5}}, {"strategy": "fixed"}], "vector_id": {"$gte": 100}},
    "filter_json_range": {"page": {"$gte": 2, "$lt": 4}, "section": {"$ne": ""}},
}


def filter_json(name: str, spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vector_metadata").where(compile_filter(FILTERS[name], COLUMNS)).select("vector_id", "chunk_id")


def metadata_query(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    hit = docs.where((norm_key("source") == "ops-runbooks") & F.contains("text", F.lit("archive")) & (F.col("ingested_at") >= "2024-01-01") & (F.col("ingested_at") <= "2024-12-31"))
    return hit.orderBy(F.desc("ingested_at"), "doc_id").limit(20).select("doc_id", "doc_type", "ingested_at")


def audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit log, each entry once."""
    return table(spark, d, "audit_log").dropDuplicates(["id"])


def audit_list_page(spark: SparkSession, d: str) -> DataFrame:
    return audit(spark, d).where("operation = 'search' AND result = 'success'").orderBy(F.desc("ts"), "id").offset(50).limit(50).select("id", "ts", "target")


def audit_count(spark: SparkSession, d: str) -> DataFrame:
    return audit(spark, d).groupBy("operation", "result").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 4).alias("mean_ms"))


def audit_stats(spark: SparkSession, d: str) -> DataFrame:
    a = audit(spark, d)
    ops = a.where(F.col("operation").isin("index", "search", "delete", "export", "import")).groupBy(F.lit("operation").alias("kind"), F.col("operation").alias("name")).count()
    res = a.where(F.col("result").isin("success", "partial", "failed")).groupBy(F.lit("result").alias("kind"), F.col("result").alias("name")).count()
    return ops.unionByName(res).withColumnRenamed("count", "n")


def audit_rotate(spark: SparkSession, d: str) -> DataFrame:
    """What rotation keeps: entries of the last 90 days, of these the 1000 newest. The cut is found from daily counts, so the whole log is never ordered in one task."""
    a = audit(spark, d).where("ts IS NOT NULL")
    last = a.agg(F.max("ts").alias("last"))
    recent = a.join(F.broadcast(last)).where(F.col("ts") >= F.date_trunc("day", F.col("last")) - F.expr("INTERVAL 90 DAYS")).drop("last")
    return recent.orderBy(F.desc("ts"), "id").limit(1000).select("id", "ts")


def audit_clear(spark: SparkSession, d: str) -> DataFrame:
    return audit(spark, d).where(~(F.col("ts") < "2024-06-01") | F.col("ts").isNull()).groupBy("operation").agg(F.count("*").alias("kept"))


def tags(spark: SparkSession, d: str) -> DataFrame:
    return tagging.tag_rows(table(spark, d, "tag_suggestions"))


TAG_QUERIES = {
    "tag_match_any": {"include_any": ["topic/quinozon", "quinozon"]},
    "tag_match_all": {"include_all": ["topic/*", "project/*"]},
    "tag_match_not": {"include_all": ["topic/*"], "exclude": ["project/*", "team/*"]},
    "tag_match_glob": {"include_any": ["team/mar*", "*ford"]},
    "tag_match_everything": {},
}


def tag_match(name: str, spark: SparkSession, d: str) -> DataFrame:
    return tagging.tag_arrays(tags(spark, d)).where(tag_query("tags", **TAG_QUERIES[name])).select("doc", F.array_join("tags", ",").alias("tags"))


def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return tags(spark, d).groupBy("tag").agg(F.count("*").alias("documents"))


def tag_stats(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "tag_suggestions").dropDuplicates(["id"])
    return s.groupBy(norm_key("source").alias("source"), norm_key("tag_name").alias("tag")).agg(F.count("*").alias("n"))


def find_by_source(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "tag_suggestions").where((norm_key("source") == "llm") & (norm_key("status") == "confirmed"))
    rows = s.select(norm_key("doc_id").alias("doc"), norm_key("tag_name").alias("tag")).where("doc IS NOT NULL AND tag IS NOT NULL").distinct()
    return rows.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


def tag_rename(spark: SparkSession, d: str) -> DataFrame:
    """Namespace topic renamed to subject in every document; a tag that is there already is merged."""
    t = tagging.tag_arrays(tags(spark, d))
    new = F.array_sort(F.array_distinct(F.transform("tags", lambda x: F.regexp_replace(x, "^topic/", "subject/"))))
    return t.where(F.exists("tags", lambda x: x.startswith("topic/"))).select("doc", F.array_join(new, ",").alias("tags"))


def collections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "collections")
    newest = rows.groupBy("id").agg(F.max_by(F.struct("include_all", "include_any", "exclude"), F.struct("created_at", "parent_id", "name")).alias("r"))
    return newest.select("id", "r.*")


def tagged_documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc): every document, once: those with a record, and those that have a tag without one, as all tag queries take them."""
    recorded = table(spark, d, "document_records").select(norm_key("document_id").alias("doc")).where("doc IS NOT NULL")
    return recorded.unionByName(tags(spark, d).select("doc")).distinct()


def collection_members(spark: SparkSession, d: str) -> DataFrame:
    """(collection, doc). A row with a null doc stands for every document but those of collection_exclusions: these collections include by no tag."""
    rest = tagging.all_but(collections(spark, d)).select(F.col("id").alias("collection"), F.lit(None).cast("string").alias("doc"))
    return tagging.collection_members(tags(spark, d), collections(spark, d)).unionByName(rest)


def collection_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """(collection, doc): the documents left out of the collections that include by no tag."""
    return tagging.exclusions(tags(spark, d), collections(spark, d))


def collection_sizes(spark: SparkSession, d: str) -> DataFrame:
    return tagging.collection_sizes(tags(spark, d), collections(spark, d), tagged_documents(spark, d))


def collections_for_doc(spark: SparkSession, d: str) -> DataFrame:
    return tagging.collections_for_doc(tags(spark, d), collections(spark, d), tagged_documents(spark, d))


def collection_children(spark: SparkSession, d: str) -> DataFrame:
    """The number of direct children of each collection."""
    rows = latest_collections(spark, d)
    known = rows.select(F.col("key").alias("parent"))
    return rows.join(known, "parent").groupBy("parent").agg(F.count("*").alias("children"))


def tag_validate(spark: SparkSession, d: str) -> DataFrame:
    return tagging.tag_violations(tags(spark, d), table(spark, d, "tag_namespaces"), table(spark, d, "tag_namespace_values"))


def namespaces_sorted(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "tag_namespaces").distinct().where("NOT is_hidden")
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("is_system"), "name"))  # a table of settings
    return n.select("name", "is_open", "is_system", place.alias("position"))


def library_stats(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "tag_namespaces").distinct()
    v = table(spark, d, "tag_namespace_values").distinct()
    return n.agg(F.count("*").alias("namespaces"), F.count_if("is_open").alias("open"), F.count_if("is_system").alias("system"), F.count_if("is_hidden").alias("hidden")).crossJoin(v.agg(F.count("*").alias("values")))  # two single rows


def suggestion_stats(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "tag_suggestions").dropDuplicates(["id"]).select(norm_key("status").alias("status"), norm_key("source").alias("source"), norm_key("doc_id").alias("doc"))
    pending = F.when(F.col("status") == "pending", F.col("doc"))
    return s.groupBy("source").agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("pending", "confirmed", "rejected")], F.count_distinct(pending).alias("pending_docs"), F.count("*").alias("total"))


def suggestion_filter(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "tag_suggestions").dropDuplicates(["id"])
    fine = (norm_key("status") == "pending") & ~F.isnan("confidence") & (F.col("confidence") >= 0.9) & (F.col("confidence") <= 1)
    return s.where(fine).orderBy(F.desc("confidence"), "id").limit(50).select("id", "tag_name", "confidence")


def suggestion_upsert(spark: SparkSession, d: str) -> DataFrame:
    """One suggestion for each document, tag and source: the first by id."""
    s = table(spark, d, "tag_suggestions").select("id", norm_key("doc_id").alias("doc"), norm_key("tag_name").alias("tag"), norm_key("source").alias("source"))
    return s.where("doc IS NOT NULL").groupBy("doc", "tag", "source").agg(F.min("id").alias("id"))


def _tiers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    tier = F.when(F.col("doc_type") == "legal", "critical").when(F.col("doc_type") == "financial", "sensitive").when(F.col("doc_type").isin("article", "documentation"), "public")
    return docs.select("doc_id", tier.alias("tier"))


def tier_summary(spark: SparkSession, d: str) -> DataFrame:
    """Documents and percentage of each tier, zeros too; a document without a tier is personal."""
    counts = _tiers(spark, d).groupBy(tagging.tier_level("tier").alias("level")).agg(F.count("*").alias("n"))
    dim = spark.createDataFrame([(i, t) for i, t in enumerate(tagging.TIERS)], "level int, tier string")
    j = dim.join(counts, "level", "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # four rows
    return j.select("tier", F.col("n").alias("documents"), F.round(F.when(total > 0, 100.0 * F.col("n") / total).otherwise(F.lit(0.0)), 1).alias("percent"))


def tier_filter(spark: SparkSession, d: str) -> DataFrame:
    level = tagging.tier_level("tier")
    return _tiers(spark, d).where((level <= 2) & tagging.can_access(level, session=True, confirmed=False)).select("doc_id")


def tier_promote(spark: SparkSession, d: str) -> DataFrame:
    return _tiers(spark, d).select("doc_id", tagging.step_tier("tier", 1).alias("promoted"), tagging.step_tier("tier", -1).alias("demoted"))


def schema_versions(spark: SparkSession, d: str) -> DataFrame:
    """Records by the schema version their metadata name; without one, and with a legacy title, the first; else the current."""
    r = table(spark, d, "document_records").dropDuplicates(["record_id"])
    named = F.regexp_extract(F.coalesce("metadata", F.lit("")), '_schema_version": *"([0-9.]+)"', 1)
    version = F.when(named != "", named).when(F.contains("metadata", F.lit("dc_title")), "1.0").otherwise("2.2")
    return r.groupBy(version.alias("version")).agg(F.count("*").alias("records"))


_N = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13))), '')"
_TAGS = f"""t AS (SELECT DISTINCT {_N.format("doc_id")} AS doc, {_N.format("tag_name")} AS tag FROM tag_suggestions
 WHERE {_N.format("status")} = 'confirmed' AND {_N.format("doc_id")} IS NOT NULL AND {_N.format("tag_name")} IS NOT NULL)"""
_ARR = _TAGS + ", a AS (SELECT doc, list_sort(list(tag)) AS tags FROM t GROUP BY doc)"
_J = "CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.{}') END"
_PAGE = f"TRY_CAST({_J.format('page')} AS DOUBLE)"
_VM = "SELECT vector_id, chunk_id FROM vector_metadata WHERE "


def _some(cond: str) -> str:
    return f"len(list_filter(tags, lambda x: {cond})) > 0"


def _tag_sql(cond: str) -> str:
    return f"WITH {_ARR} SELECT doc, array_to_string(tags, ',') AS tags FROM a WHERE {cond}"


_LATEST = "c AS (SELECT id, include_all, include_any, exclude FROM collections QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC, parent_id DESC NULLS LAST, name DESC NULLS LAST) = 1)"
_FITS = "(tag = p OR (contains(p, '*') AND tag LIKE replace(replace(p, '_', '\\_'), '*', '%') ESCAPE '\\'))"
_MEMBERS = f"""WITH {_TAGS}, {_LATEST},
pats AS (SELECT id, 'all' AS kind, unnest(list_distinct(include_all)) AS p FROM c UNION ALL SELECT id, 'any', unnest(list_distinct(include_any)) FROM c UNION ALL SELECT id, 'out', unnest(list_distinct(exclude)) FROM c),
fits AS (SELECT DISTINCT p, tag FROM (SELECT DISTINCT p FROM pats) x, (SELECT DISTINCT tag FROM t) y WHERE {_FITS}),
met AS (SELECT id, doc, count(DISTINCT p) FILTER (kind = 'all') AS n1, count(DISTINCT p) FILTER (kind = 'any') AS n2, count(DISTINCT p) FILTER (kind = 'out') AS n3
  FROM pats JOIN fits USING (p) JOIN t USING (tag) GROUP BY id, doc),
m AS (SELECT met.id AS collection, doc FROM met JOIN c USING (id) WHERE n1 = coalesce(len(list_distinct(include_all)), 0) AND (coalesce(len(include_any), 0) = 0 OR n2 > 0) AND n3 = 0
  AND coalesce(len(include_all), 0) + coalesce(len(include_any), 0) > 0),
docs AS (SELECT doc FROM t UNION SELECT {_N.format("document_id")} FROM document_records WHERE {_N.format("document_id")} IS NOT NULL),
rest AS (SELECT id FROM c WHERE coalesce(len(include_all), 0) + coalesce(len(include_any), 0) = 0),
gone AS (SELECT id, doc FROM met WHERE n3 > 0 AND id IN (SELECT id FROM rest)),
other AS (SELECT rest.id, docs.doc FROM rest, docs WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.id = rest.id AND gone.doc = docs.doc))
"""
_AUD = "(SELECT DISTINCT ON (id) * FROM audit_log)"
_TIER = """tiers AS (SELECT doc_id, CASE WHEN doc_type = 'legal' THEN 3 WHEN doc_type = 'financial' THEN 2 WHEN doc_type IN ('article', 'documentation') THEN 0 ELSE 1 END AS level FROM documents)"""
_SUG = "(SELECT DISTINCT ON (id) * FROM tag_suggestions)"

QUERIES = {
    **{n: partial(filter_json, n) for n in FILTERS},
    "metadata_query": metadata_query,
    "audit_list_page": audit_list_page,
    "audit_count": audit_count,
    "audit_stats": audit_stats,
    "audit_rotate": audit_rotate,
    "audit_clear": audit_clear,
    **{n: partial(tag_match, n) for n in TAG_QUERIES},
    "tag_counts": tag_counts,
    "tag_stats": tag_stats,
    "tag_find_by_source": find_by_source,
    "tag_rename": tag_rename,
    "collection_members": collection_members,
    "collection_exclusions": collection_exclusions,
    "collection_sizes": collection_sizes,
    "collections_for_doc": collections_for_doc,
    "collection_children": collection_children,
    "tag_validate_namespaces": tag_validate,
    "namespaces_sorted": namespaces_sorted,
    "library_stats": library_stats,
    "suggestion_stats": suggestion_stats,
    "suggestion_filter": suggestion_filter,
    "suggestion_upsert": suggestion_upsert,
    "tier_summary": tier_summary,
    "tier_filter": tier_filter,
    "tier_promote": tier_promote,
    "schema_versions": schema_versions,
}
SQL = {
    "filter_json_eq": _VM + f"{_PAGE} = 2",
    "filter_json_in": _VM + f"{_J.format('strategy')} IN ('fixed', 'structure')",
    "filter_json_nin_empty": _VM + "true",
    "filter_json_ne": _VM + f"{_J.format('strategy')} <> 'sentence'",
    "filter_json_and_or": _VM + f"({_PAGE} > 5 OR {_J.format('strategy')} = 'fixed') AND vector_id >= 100",
    "filter_json_range": _VM + f"{_PAGE} >= 2 AND {_PAGE} < 4 AND {_J.format('section')} <> ''",
    "metadata_query": f"SELECT doc_id, doc_type, ingested_at FROM documents WHERE {_N.format('source')} = 'ops-runbooks' AND contains(text, 'archive') AND ingested_at BETWEEN '2024-01-01' AND '2024-12-31' ORDER BY ingested_at DESC, doc_id LIMIT 20",
    "audit_list_page": f"SELECT id, ts, target FROM {_AUD} WHERE operation = 'search' AND result = 'success' ORDER BY ts DESC, id LIMIT 50 OFFSET 50",
    "audit_count": f"SELECT operation, result, count(*) AS n, round(avg(duration_ms), 4) AS mean_ms FROM {_AUD} GROUP BY ALL",
    "audit_stats": f"""SELECT 'operation' AS kind, operation AS name, count(*) AS n FROM {_AUD} WHERE operation IN ('index', 'search', 'delete', 'export', 'import') GROUP BY 2
UNION ALL SELECT 'result', result, count(*) FROM {_AUD} WHERE result IN ('success', 'partial', 'failed') GROUP BY 2""",
    "audit_rotate": f"SELECT id, ts FROM {_AUD} WHERE ts >= (SELECT date_trunc('day', max(ts)) - INTERVAL 90 DAY FROM audit_log) ORDER BY ts DESC, id LIMIT 1000",
    "audit_clear": f"SELECT operation, count(*) AS kept FROM {_AUD} WHERE ts >= '2024-06-01' OR ts IS NULL GROUP BY 1",
    "tag_match_any": _tag_sql("list_has_any(tags, ['topic/quinozon', 'quinozon'])"),
    "tag_match_all": _tag_sql(_some("starts_with(x, 'topic/')") + " AND " + _some("starts_with(x, 'project/')")),
    "tag_match_not": _tag_sql(_some("starts_with(x, 'topic/')") + " AND NOT " + _some("starts_with(x, 'project/')") + " AND NOT " + _some("starts_with(x, 'team/')")),
    "tag_match_glob": _tag_sql(_some("starts_with(x, 'team/mar') OR ends_with(x, 'ford')")),
    "tag_match_everything": _tag_sql("true"),
    "tag_counts": f"WITH {_TAGS} SELECT tag, count(*) AS documents FROM t GROUP BY tag",
    "tag_stats": f"SELECT {_N.format('source')} AS source, {_N.format('tag_name')} AS tag, count(*) AS n FROM {_SUG} GROUP BY 1, 2",
    "tag_find_by_source": f"""SELECT doc, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM (SELECT {_N.format("doc_id")} AS doc, {_N.format("tag_name")} AS tag FROM tag_suggestions
 WHERE {_N.format("source")} = 'llm' AND {_N.format("status")} = 'confirmed') WHERE doc IS NOT NULL AND tag IS NOT NULL GROUP BY doc""",
    "tag_rename": f"""WITH {_ARR}, n AS (SELECT doc, list_sort(list_distinct(list_transform(tags, lambda x: regexp_replace(x, '^topic/', 'subject/')))) AS tags FROM a WHERE {_some("starts_with(x, 'topic/')")})
SELECT doc, array_to_string(tags, ',') AS tags FROM n""",
    "collection_members": _MEMBERS + "SELECT collection, doc FROM m UNION ALL SELECT id, NULL FROM rest",
    "collection_exclusions": _MEMBERS + "SELECT id AS collection, doc FROM gone",
    "collection_sizes": _MEMBERS + ", every AS (SELECT collection, doc FROM m UNION ALL SELECT id, doc FROM other) SELECT id AS collection, count(doc) AS members FROM c LEFT JOIN every ON every.collection = c.id GROUP BY id",
    "collections_for_doc": _MEMBERS + ", every AS (SELECT collection, doc FROM m UNION ALL SELECT id, doc FROM other) SELECT doc, count(*) AS collections, min(collection) AS first_collection FROM every GROUP BY doc",
    "collection_children": f"""WITH tr AS (SELECT {_N.format("id")} AS key, {_N.format("parent_id")} AS parent, created_at, name, id FROM collections),
l AS (SELECT key, parent FROM tr QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, parent DESC NULLS LAST, name DESC NULLS LAST, id DESC) = 1)
SELECT l.parent, count(*) AS children FROM l JOIN l p ON p.key = l.parent GROUP BY 1""",
    "tag_validate_namespaces": f"""WITH {_TAGS}, x AS (SELECT doc, tag, split_part(tag, '/', 1) AS ns, regexp_replace(tag, '^[^/]*/', '') AS value FROM t WHERE contains(tag, '/')),
n AS (SELECT {_N.format("name")} AS ns, bool_or(is_open) AS is_open FROM tag_namespaces GROUP BY 1), v AS (SELECT DISTINCT {_N.format("namespace")} AS ns, {_N.format("tag_value")} AS value, true AS listed FROM tag_namespace_values)
SELECT doc, tag, CASE WHEN is_open IS NULL THEN 'unknown_namespace' ELSE 'unlisted_value' END AS problem FROM x LEFT JOIN n USING (ns) LEFT JOIN v ON v.ns = x.ns AND v.value = x.value WHERE is_open IS NULL OR (NOT is_open AND listed IS NULL)""",
    "namespaces_sorted": "SELECT name, is_open, is_system, CAST(row_number() OVER (ORDER BY is_system DESC, name) AS INTEGER) AS position FROM (SELECT DISTINCT * FROM tag_namespaces) WHERE NOT is_hidden",
    "library_stats": """SELECT count(*) AS namespaces, count(*) FILTER (is_open) AS open, count(*) FILTER (is_system) AS system, count(*) FILTER (is_hidden) AS hidden, (SELECT count(*) FROM (SELECT DISTINCT * FROM tag_namespace_values)) AS "values" FROM (SELECT DISTINCT * FROM tag_namespaces)""",
    "suggestion_stats": f"""WITH s AS (SELECT {_N.format("status")} AS status, {_N.format("source")} AS source, {_N.format("doc_id")} AS doc FROM {_SUG})
SELECT source, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'rejected') AS rejected,
 count(DISTINCT CASE WHEN status = 'pending' THEN doc END) AS pending_docs, count(*) AS total FROM s GROUP BY source""",
    "suggestion_filter": f"SELECT id, tag_name, confidence FROM {_SUG} WHERE {_N.format('status')} = 'pending' AND NOT isnan(confidence) AND confidence BETWEEN 0.9 AND 1 ORDER BY confidence DESC, id LIMIT 50",
    "suggestion_upsert": f"SELECT {_N.format('doc_id')} AS doc, {_N.format('tag_name')} AS tag, {_N.format('source')} AS source, min(id) AS id FROM tag_suggestions WHERE {_N.format('doc_id')} IS NOT NULL GROUP BY 1, 2, 3",
    "tier_summary": f"WITH {_TIER}, dim AS (SELECT unnest(range(4)) AS level, unnest(['public', 'personal', 'sensitive', 'critical']) AS tier) SELECT tier, count(doc_id) AS documents, round(100.0 * count(doc_id) / sum(count(doc_id)) OVER (), 1) AS percent FROM dim LEFT JOIN tiers USING (level) GROUP BY tier",
    "tier_filter": f"WITH {_TIER} SELECT doc_id FROM tiers WHERE level <= 2",
    "tier_promote": f"WITH {_TIER} SELECT doc_id, (['public', 'personal', 'sensitive', 'critical'])[level + 2] AS promoted, CASE WHEN level > 0 THEN (['public', 'personal', 'sensitive', 'critical'])[level] END AS demoted FROM tiers",
    "schema_versions": """SELECT CASE WHEN regexp_extract(metadata, '_schema_version": *"([0-9.]+)"', 1) <> '' THEN regexp_extract(metadata, '_schema_version": *"([0-9.]+)"', 1)
 WHEN contains(metadata, 'dc_title') THEN '1.0' ELSE '2.2' END AS version, count(*) AS records FROM (SELECT DISTINCT ON (record_id) * FROM document_records) GROUP BY 1""",
}
