"""Changes of tags, collections, namespaces and suggestions, and metadata from version to version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import schema
from docweave.functions.keys import norm_key
from docweave.operators import tagedits
from docweave.session import table

#: The prefix of the application's keys in the metadata of document_records is cut off, whatever it is: it is read from the table's keys.
_OWN = r'"([a-z]+)_(?:project|schema_version|source_path)"'


def documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc, tags) of confirmed suggestions."""
    return tagedits.confirmed_tags(table(spark, d, "tag_suggestions"))


def _out(edited: DataFrame) -> DataFrame:
    return edited.where("changed").select("doc", F.array_join(tagedits.names_of("tags"), ",").alias("tags"))


def tags_add(spark: SparkSession, d: str) -> DataFrame:
    """Documents that get the tag checked, by hand, if they have a tag of topic."""
    new = F.array(tagedits.entry(" Checked "))
    has = F.exists("tags", lambda t: t["name"].startswith("topic/"))
    return _out(tagedits.edit(documents(spark, d), "doc", "tags", tagedits.add("tags", new), has))


def tags_remove(spark: SparkSession, d: str) -> DataFrame:
    """Documents that lose quinozon, or tags that a language model gave."""
    return _out(tagedits.edit(documents(spark, d), "doc", "tags", tagedits.remove("tags", ["Quinozon"], "auto-llm")))


def tags_rename(spark: SparkSession, d: str) -> DataFrame:
    """Namespace topic renamed to subject."""
    return _out(tagedits.edit(documents(spark, d), "doc", "tags", tagedits.rename("tags", "topic/", "subject/")))


def tags_delete(spark: SparkSession, d: str) -> DataFrame:
    """The tag quinozon deleted everywhere: how many documents change, and tags that stay."""
    e = tagedits.edit(documents(spark, d), "doc", "tags", tagedits.remove("tags", ["quinozon"]))
    return e.agg(F.count_if("changed").alias("changed"), F.sum(F.size("tags")).alias("tags"))


def tag_sources(spark: SparkSession, d: str) -> DataFrame:
    """Tags by the source that a confirmed suggestion leaves on a document."""
    each = documents(spark, d).select(F.explode("tags").alias("t"))
    return each.groupBy("t.source").agg(F.count("*").alias("tags"), F.round(F.avg("t.confidence"), 6).alias("mean_confidence"))


def suggestions_decided(spark: SparkSession, d: str) -> DataFrame:
    """Statuses after pending suggestions of 0.9 or more are confirmed, and then those named quinozon rejected."""
    s = table(spark, d, "tag_suggestions").dropDuplicates(["id"])
    s = tagedits.decide(tagedits.decide(s, True, least=0.9), False, names=["quinozon"])
    return s.groupBy(norm_key("status").alias("status")).agg(F.count("*").alias("suggestions"))


def collection_delete(spark: SparkSession, d: str) -> DataFrame:
    """Roots and other collections after those whose name begins with archived are deleted."""
    c = table(spark, d, "collections")
    names = [r[0] for r in c.where("name LIKE 'archived search endpoint%'").select("name").distinct().collect()]  # the names to delete
    rest = tagedits.delete_collections(c, names)
    return rest.groupBy(norm_key("parent_id").isNull().alias("root")).agg(F.count("*").alias("collections"))


def namespace_create(spark: SparkSession, d: str) -> DataFrame:
    """Namespaces and listed values after a closed one with two values is made and its values promoted from pending suggestions."""
    n, v = tagedits.create_namespace(table(spark, d, "tag_namespaces").distinct(), table(spark, d, "tag_namespace_values").distinct(), "Curation-State-2", False, ["Open", "Done"])
    pending = table(spark, d, "tag_suggestions").dropDuplicates(["id"]).where(norm_key("status") == "pending")
    left, v = tagedits.promote_pending(pending, v, ["quinozon", "topic/quinozon"], "curation-state-2")
    count = lambda df, name: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    return count(n, "namespaces").unionByName(count(v.where(norm_key("namespace") == "curation-state-2"), "values")).unionByName(count(left, "pending"))


def schema_current(spark: SparkSession, d: str) -> DataFrame:
    """The metadata of every record in the current version."""
    r = table(spark, d, "document_records").dropDuplicates(["record_id"])
    prefix = r.select(F.regexp_extract("metadata", _OWN, 1).alias("p")).where("p <> ''").groupBy("p").count().orderBy(F.desc("count"), "p").first()  # one row
    m = schema.migrated(r, "metadata", prefix["p"] if prefix else "app")
    fields = ("title", "language", "project", "sensitivity", "data_tier", "schema_version")
    return m.select("record_id", "from_version", *[F.col(f"meta.{f}").alias(f) for f in fields], F.array_join(tagedits.names_of("meta.tags"), ",").alias("tags"))


_N = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13))), '')"
_S = f"""s AS (SELECT {_N.format("doc_id")} AS doc, {_N.format("tag_name")} AS name, {_N.format("source")} AS source, CASE WHEN NOT isnan(confidence) THEN confidence END AS confidence, source_model FROM tag_suggestions WHERE {_N.format("status")} = 'confirmed'),
b AS (SELECT doc, name, CASE source WHEN 'keybert' THEN 'auto-keybert' WHEN 'llm' THEN 'auto-llm' WHEN 'ner' THEN 'auto-ner' ELSE source END AS source, confidence FROM s WHERE doc IS NOT NULL AND name IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY doc, name ORDER BY confidence DESC NULLS LAST, 3 DESC NULLS LAST, source_model DESC NULLS LAST) = 1)"""
_J = "array_to_string(list_sort(list(DISTINCT name)), ',') AS tags"
_SUG = "(SELECT DISTINCT ON (id) * FROM tag_suggestions)"
_REC = "(SELECT DISTINCT ON (record_id) * FROM document_records)"
_OBJ = "CASE WHEN json_valid(metadata) THEN metadata END"


def _own(key: str) -> str:
    return f"json_extract_string({_OBJ}, (SELECT '$.' || p || '_{key}' FROM pre))"


QUERIES = {
    "tags_add": tags_add,
    "tags_remove": tags_remove,
    "tags_rename_namespace": tags_rename,
    "tags_delete": tags_delete,
    "tag_sources": tag_sources,
    "suggestions_decided": suggestions_decided,
    "collection_delete": collection_delete,
    "namespace_create": namespace_create,
    "schema_current": schema_current,
}
SQL = {
    "tags_add": f"WITH {_S}, h AS (SELECT doc FROM b GROUP BY 1 HAVING bool_or(starts_with(name, 'topic/')) AND NOT bool_or(name = 'checked')) SELECT doc, {_J} FROM (SELECT doc, name FROM b UNION ALL SELECT doc, 'checked' FROM h) WHERE doc IN (SELECT doc FROM h) GROUP BY 1",
    "tags_remove": f"WITH {_S}, h AS (SELECT doc FROM b WHERE name = 'quinozon' OR source = 'auto-llm') SELECT doc, coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN name <> 'quinozon' AND source <> 'auto-llm' THEN name END)), ','), '') AS tags FROM b WHERE doc IN (SELECT doc FROM h) GROUP BY 1",
    "tags_rename_namespace": f"WITH {_S}, h AS (SELECT doc FROM b WHERE starts_with(name, 'topic/')) SELECT doc, {_J} FROM (SELECT doc, regexp_replace(name, '^topic/', 'subject/') AS name FROM b) WHERE doc IN (SELECT doc FROM h) GROUP BY 1",
    "tags_delete": f"WITH {_S} SELECT count(DISTINCT doc) FILTER (name = 'quinozon') AS changed, count(*) FILTER (name <> 'quinozon') AS tags FROM b",
    "tag_sources": f"WITH {_S} SELECT source, count(*) AS tags, round(avg(confidence), 6) AS mean_confidence FROM b GROUP BY 1",
    "suggestions_decided": f"""SELECT CASE WHEN st = 'pending' AND sure THEN 'confirmed' WHEN st = 'pending' AND name = 'quinozon' THEN 'rejected' ELSE st END AS status, count(*) AS suggestions
FROM (SELECT {_N.format("status")} AS st, {_N.format("tag_name")} AS name, coalesce(confidence >= 0.9 AND confidence::VARCHAR <> 'nan', false) AS sure FROM {_SUG}) GROUP BY 1""",
    "collection_delete": f"""WITH g AS (SELECT DISTINCT lower(trim(name, ' ' || chr(9) || chr(10) || chr(13))) AS n FROM collections WHERE name LIKE 'archived search endpoint%'), x AS (SELECT *, coalesce({_N.format("name")} IN (SELECT n FROM g), false) AS gone FROM collections)
SELECT p IS NULL OR p IN (SELECT {_N.format("id")} FROM x WHERE gone) AS root, count(*) AS collections FROM (SELECT {_N.format("parent_id")} AS p FROM x WHERE NOT gone) GROUP BY 1""",
    "namespace_create": f"""WITH p AS (SELECT coalesce({_N.format("tag_name")} IN ('quinozon', 'topic/quinozon'), false) AS hit, {_N.format("tag_name")} AS t FROM {_SUG} WHERE {_N.format("status")} = 'pending')
SELECT 'namespaces' AS what, count(*) + 1 AS n FROM (SELECT DISTINCT * FROM tag_namespaces) UNION ALL SELECT 'values', 2 + (SELECT count(DISTINCT t) FROM p WHERE hit) UNION ALL SELECT 'pending', count(*) FILTER (NOT hit) FROM p""",
    "schema_current": f"""WITH pre AS (SELECT p FROM (SELECT regexp_extract(metadata, '{_OWN}', 1) AS p FROM {_REC}) WHERE p <> '' GROUP BY 1 ORDER BY count(*) DESC, p LIMIT 1),
r AS (SELECT record_id, metadata, CASE WHEN regexp_extract(metadata, '"[a-z]+_schema_version"\\s*:\\s*"([0-9.]+)"', 1) <> '' THEN regexp_extract(metadata, '"[a-z]+_schema_version"\\s*:\\s*"([0-9.]+)"', 1)
 WHEN regexp_matches(metadata, '"source_path"\\s*:') AND NOT regexp_matches(metadata, '"[a-z]+_source_path"\\s*:') THEN '1.0' ELSE '2.2' END AS from_version FROM {_REC}),
f AS (SELECT record_id, from_version, json_extract_string({_OBJ}, '$.dc_title') AS title, json_extract_string({_OBJ}, '$.dc_language') AS language, coalesce({_own("project")}, '') AS project, coalesce({_own("sensitivity")}, 'public') AS sensitivity, {_own("data_tier")} AS tier, coalesce({_own("tags")}, '[]') AS tags FROM r)
SELECT record_id, from_version, coalesce(title, CASE WHEN from_version = '1.0' THEN '' END) AS title, coalesce(language, CASE WHEN from_version = '1.0' THEN 'en' END) AS language, project, sensitivity,
 coalesce(tier, CASE sensitivity WHEN 'public' THEN 'public' WHEN 'internal' THEN 'personal' WHEN 'confidential' THEN 'sensitive' ELSE 'personal' END) AS data_tier, '2.2' AS schema_version,
 array_to_string(list_sort(list_distinct(list_filter(list_transform(from_json(tags, '["VARCHAR"]'), lambda x: lower(trim(x))), lambda x: x <> ''))), ',') AS tags FROM f""",
}
