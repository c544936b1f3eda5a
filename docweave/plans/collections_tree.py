"""Problem 5: the trees of collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.keys import norm_key
from docweave.operators.hierarchy import closure, cycle_members, descendant_counts, hierarchy
from docweave.session import table


def latest_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, key, parent): the latest row of each id by created_at; ties by the larger parent, then name."""
    rows = table(spark, sf_dir, "collections").select("id", norm_key("id").alias("key"), norm_key("parent_id").alias("parent"), "created_at", "name")
    newest = F.max_by(F.struct("id", "parent"), F.struct(F.col("created_at"), F.col("parent"), F.col("name"), F.col("id")))
    return rows.where(F.col("key").isNotNull()).groupBy("key").agg(newest.alias("r")).select("key", "r.id", "r.parent")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections on a circle of parent links."""
    rows = latest_collections(spark, sf_dir)
    found = cycle_members(rows, "key", "parent").withColumnRenamed("id", "key")
    named = found.join(rows.select("key", "id"), "key")
    names = named.groupBy(F.col("cycle_id").alias("c")).agg(F.min("id").alias("smallest"))
    return named.join(names, named["cycle_id"] == names["c"]).select(F.col("smallest").alias("cycle_id"), "id")


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root and number of descendants of every collection; null where a circle is above it."""
    rows = latest_collections(spark, sf_dir)
    tree = hierarchy(rows, "key", "parent")
    counts = descendant_counts(tree)
    return tree.join(counts, "id", "left").select("id", "root", "depth", F.array_join("path", " > ").alias("path"), "descendants")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every collection with each collection below it."""
    return closure(hierarchy(latest_collections(spark, sf_dir), "key", "parent"))


_LATEST = """
WITH RECURSIVE trimmed AS (
  SELECT lower(trim(id, ' ' || chr(9) || chr(10) || chr(13))) AS key, id, created_at, name,
         nullif(lower(trim(parent_id, ' ' || chr(9) || chr(10) || chr(13))), '') AS parent FROM collections),
latest AS (
  SELECT key, id, parent FROM trimmed
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, parent DESC NULLS LAST, name DESC NULLS LAST, id DESC) = 1),
linked AS (SELECT l.key, l.id, p.key AS parent FROM latest l LEFT JOIN latest p ON l.parent = p.key),
"""
_TREE = (
    _LATEST
    + """
tree AS (
  SELECT key AS id, key AS root, 0 AS depth, [key] AS steps FROM linked WHERE parent IS NULL
  UNION ALL
  SELECT l.key, t.root, t.depth + 1, list_append(t.steps, l.key) FROM linked l JOIN tree t ON l.parent = t.id),
pairs AS (SELECT id AS descendant, unnest(steps) AS ancestor, unnest(range(len(steps))) AS i, depth FROM tree),
closure AS (SELECT ancestor, descendant, CAST(depth - i AS INTEGER) AS distance FROM pairs WHERE i < depth)
"""
)
QUERIES = {"p5_found": p5_found, "p5_hierarchy": p5_hierarchy, "p5_descendants": p5_descendants}
SQL = {
    "p5_found": _LATEST
    + """
reach AS (
  SELECT key AS start, parent AS node FROM linked WHERE parent IS NOT NULL
  UNION
  SELECT r.start, l.parent FROM reach r JOIN linked l ON l.key = r.node WHERE l.parent IS NOT NULL),
on_cycle AS (SELECT start AS key FROM reach WHERE start = node),
circles AS (SELECT r.start AS key, min(r.node) AS circle FROM reach r JOIN on_cycle a ON a.key = r.start JOIN on_cycle b ON b.key = r.node GROUP BY 1),
named AS (SELECT circle, id FROM circles JOIN linked USING (key))
SELECT min(id) OVER (PARTITION BY circle) AS cycle_id, id FROM named""",
    "p5_hierarchy": _TREE
    + """
SELECT l.key AS id, t.root, t.depth, array_to_string(t.steps, ' > ') AS path,
       CASE WHEN t.id IS NOT NULL THEN (SELECT count(*) FROM closure c WHERE c.ancestor = l.key) END AS descendants
FROM linked l LEFT JOIN tree t ON t.id = l.key""",
    "p5_descendants": _TREE + "SELECT ancestor, descendant, distance FROM closure",
}
