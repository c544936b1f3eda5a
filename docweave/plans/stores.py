"""The kept keyword index and the document store."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.keys import iso_instant, norm_key
from docweave.operators.documents import DocumentStore, export_filter, export_metadata
from docweave.operators.engines import HashedEmbedder, OverlapReranker, embedded, reranked
from docweave.operators.keyindex import KeywordIndex
from docweave.session import Scratch, freeing, table

_built: dict[tuple[str, str], KeywordIndex] = {}


def chunks(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vector_metadata").dropDuplicates(["vector_id"])
    return v.select(norm_key("document_id").alias("document"), F.col("vector_id").cast("string").alias("chunk"), F.col("content").alias("text"), "batch_no")


def index(spark: SparkSession, d: str) -> KeywordIndex:
    """The index over all chunks, built once a session; words are not stemmed, so that SQL can say the same."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _built:
        made = KeywordIndex(spark, Scratch(spark, "keyindex").path("index"), stemmed=False)
        made.add(chunks(spark, d))
        _built[key] = made
    return _built[key]


def index_build(spark: SparkSession, d: str) -> DataFrame:
    documents, n, mean = index(spark, d).statistics()
    return spark.createDataFrame([(documents, n, round(mean, 6))], "documents bigint, chunks bigint, mean_length double")


SEARCHES = {"or": "archive OR query OR index", "phrase": '"audit trail" AND archive', "not": "(snapshot OR glossary) NOT index*"}


def indexed(name: str, spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).search(SEARCHES[name], 50)


def index_changes(spark: SparkSession, d: str) -> DataFrame:
    """Chunks a document has after batches 1 to 20 were added, then those of later batches (each document anew), and documents that begin with 0 deleted."""
    ix = KeywordIndex(spark, Scratch(spark, "keyindex").path("changing"), stemmed=False)
    c = chunks(spark, d)
    ix.add(c.where("batch_no <= 20"))
    ix.add(c.where("batch_no > 20"))
    ix.delete(c.where("document LIKE '0%'").select("document"))
    return ix.documents().select("document", "chunks")


def _loaded(spark: SparkSession, d: str, scratch: Scratch, name: str) -> DocumentStore:
    store = DocumentStore(spark, scratch.path(name), dim=64)
    r = table(spark, d, "document_records").select(norm_key("document_id").alias("document_id"), "record_id", "path", "filename", "file_type", "file_size", iso_instant("indexed_at").alias("indexed_at"), norm_key("content_hash").alias("content_hash"), "metadata")
    r = r.where("document_id IS NOT NULL").groupBy("document_id").agg(F.max_by(F.struct("path", "filename", "file_type", "file_size", "indexed_at", "content_hash", "metadata"), "record_id").alias("r")).select("document_id", "r.*")
    # rows delivered twice are met after the exchange: what is sorted there would be sorted before it too, beside the row groups that are read
    e = table(spark, d, "chunk_embeddings").where(F.size("embedding") == 64).repartition("chunk_id").groupBy("chunk_id").agg(F.min("embedding").alias("embedding"))
    v = table(spark, d, "vector_metadata").repartition("vector_id").dropDuplicates(["vector_id"]).select(norm_key("document_id").alias("document_id"), "chunk_id", F.col("vector_id").alias("position"), "content", "metadata")
    store.add(r, v.join(e, "chunk_id", "left"))
    return store


def _kept(scratch: Scratch, result: DataFrame, *stores: str) -> DataFrame:
    """A result of a few rows, written, so that the stores it was taken from can go."""
    with freeing(scratch.spark):
        out = scratch.write("result", result)
    for name in stores:
        scratch.drop(name)
    return out


def store_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The store after all documents were added and those that begin with 0 deleted."""
    scratch = Scratch(spark, "store")
    store = _loaded(spark, d, scratch, "statistics")
    store.delete(store.documents.live().where("document_id LIKE '0%'"))
    return _kept(scratch, store.statistics(), "statistics")


def store_import(policy: str, spark: SparkSession, d: str) -> DataFrame:
    """What becomes of the documents of an archive that begin with 0 to 3 when those that begin with 0 or 1 are there: by action, the documents and chunks that the store has then."""
    scratch = Scratch(spark, "store")
    whole = _loaded(spark, d, scratch, "archive")
    store = DocumentStore(spark, scratch.path("import"), dim=64)
    docs, held = whole.documents.live(), whole.held_chunks()
    store.add(docs.where("document_id < '2'"), held.where("document_id < '2'"))
    plan = store.import_archive(docs.where("document_id < '4'"), held.where("document_id < '4'"), policy, stamp="1")
    totals = store.statistics().select(F.lit("total").alias("action"), "documents", "chunks")
    actions = plan.groupBy("action").agg(F.count("*").alias("documents"), F.lit(None).cast("bigint").alias("chunks"))
    return _kept(scratch, actions.unionByName(totals), "archive", "import")


TAGS, SINCE, UNTIL = ("topic/quinozon", "quinozon"), "2024-03-01 00:00:00", "2024-05-31 23:59:59"


def store_export(spark: SparkSession, d: str) -> DataFrame:
    """Documents to export of one kind of tag, of one project and of one period, with what an archive has of each, and the number of characters of their chunks' metadata without core keys.

    The project is the one that most documents name; where none does, all are exported. What a document lacks for the filter on
    tags is a confirmed tag, for that on projects a record whose metadata is an object.
    """
    scratch = Scratch(spark, "store")
    store = _loaded(spark, d, scratch, "export")
    m = table(spark, d, "tag_suggestions").where(norm_key("status") == "confirmed").select(norm_key("doc_id").alias("document_id"), norm_key("tag_name").alias("t")).where("document_id IS NOT NULL AND t IS NOT NULL")
    m = m.groupBy("document_id").agg(F.array_sort(F.collect_set("t")).alias("tags"))
    chars = export_metadata(store.held_chunks()).groupBy("document_id").agg(F.sum(F.length("metadata")).alias("metadata_characters"))
    with freeing(spark):  # each is read by all exports
        tags = scratch.write("export_tags", m)
        docs = scratch.write("export_documents", store.documents.live().join(chars, "document_id"))
    scratch.drop("export")
    own = F.from_json("metadata", "map<string,string>")
    records = docs.select("document_id", own.alias("own")).where("own IS NOT NULL").select("document_id", F.lit(None).cast("array<string>").alias("tags"), F.col("own")["ragd_project"].alias("project"))
    most = records.where("project <> ''").groupBy("project").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project").first()
    exports = {
        "tags": export_filter(docs, tags.withColumn("project", F.lit("")), tags=list(TAGS)),
        "project": export_filter(docs, records, project=most["project"] if most else None),
        "period": export_filter(docs, records, since=F.lit(SINCE).cast("timestamp"), until=F.lit(UNTIL).cast("timestamp")),
    }
    rows = reduce(DataFrame.unionByName, [x.withColumn("selection", F.lit(name)) for name, x in exports.items()]).join(tags, "document_id", "left")
    title, indexed = F.coalesce(own["dc_title"], "filename"), F.col("indexed_at").cast("timestamp_ntz")
    listed = F.coalesce(F.array_join("tags", ","), F.lit(""))
    return rows.select("selection", "document_id", title.alias("title"), "path", "content_hash", listed.alias("tags"), indexed.alias("indexed_at"), "chunk_count", "file_type", "file_size", "metadata_characters")


def export_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys of chunks' metadata that an export keeps, with their use."""
    v = table(spark, d, "vector_metadata").dropDuplicates(["vector_id"])
    kept = export_metadata(v, core=("page", "strategy", "document_id", "chunk_id", "content")).select(F.explode(F.map_keys(F.from_json("metadata", "map<string,string>"))).alias("key"))
    return kept.groupBy("key").agg(F.count("*").alias("chunks"))


def embedded_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Groups of documents with one vector of the hashed embedder: their size and first document."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    e = docs.select("doc_id", embedded("text", _embedder).alias("v")).where(F.exists("v", lambda x: x != 0))
    return e.groupBy(F.xxhash64("v").alias("h")).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first")).where("documents > 1").select("documents", "first")


def _embedder() -> HashedEmbedder:
    return HashedEmbedder(256)


def rerank_engine(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best chunks of a query ranked anew by the overlap engine, the 20 best of at least 0.3."""
    found = index(spark, d).search(SEARCHES["or"], 50)
    texts = chunks(spark, d).select("document", "chunk", "text")
    rows = found.join(texts, ["document", "chunk"]).withColumn("id", F.concat_ws("/", "document", "chunk"))
    return reranked(rows, "archive query index", "text", OverlapReranker, 20, 0.3).select("id", "original_rank", "rerank_score", "final_rank")


_V = "(SELECT DISTINCT ON (vector_id) * FROM vector_metadata)"
_D = "nullif(lower(trim(document_id, ' ' || chr(9) || chr(10) || chr(13))), '')"
_W = r"list_filter(regexp_split_to_array(strip_accents(lower(coalesce(content, ''))), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_C = f"c AS (SELECT {_D} AS document, CAST(vector_id AS VARCHAR) AS chunk, {_W} AS w FROM {_V} WHERE {_D} IS NOT NULL), st AS (SELECT count(*) AS n, avg(len(w)) AS l FROM c)"


def _count(word: str) -> str:
    return f"len(list_filter(w, lambda x: x = '{word}'))"


def _phrase(*words: str) -> str:
    tests = " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(words, 1))
    return f"len(list_filter(range(len(w)), lambda i: {tests}))"


def _search(items: list[str], match: str, extra: str = "false AS g") -> str:
    cols = ", ".join(f"{x} AS f{i}" for i, x in enumerate(items))
    dfs = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(items)))
    score = " + ".join(f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / l))" for i in range(len(items)))
    return f"""WITH {_C}, f AS (SELECT document, chunk, len(w) AS len, {cols}, {extra} FROM c), df AS (SELECT {dfs} FROM f),
s AS (SELECT document, chunk, round({score}, 6) AS score FROM f, df, st WHERE {match})
SELECT *, CAST(row_number() OVER (ORDER BY score DESC, document, chunk) AS INTEGER) AS rank FROM s ORDER BY score DESC, document, chunk LIMIT 50"""


_PICK = f"SELECT DISTINCT {_D} AS document_id FROM document_records WHERE {_D} IS NOT NULL"
_HELD = f"h AS (SELECT {_D} AS document_id, v.chunk_id, e.chunk_id IS NOT NULL AS has FROM {_V} v LEFT JOIN (SELECT DISTINCT chunk_id FROM chunk_embeddings WHERE len(embedding) = 64) e USING (chunk_id) WHERE {_D} IN ({_PICK})), dd AS (SELECT DISTINCT document_id FROM h)"


def _import_sql(policy: str) -> str:
    clash = {"skip": "skipped", "replace": "replaced", "merge": "merged", "rename": "renamed"}[policy]
    fresh = "document_id >= '2' AND document_id < '4' AND document_id IN (SELECT document_id FROM h WHERE has)"
    documents = f"(SELECT count(*) FROM dd WHERE document_id < '2' OR ({fresh}))"
    chunks_sql = f"(SELECT count(*) FROM h WHERE document_id < '2' OR ({fresh} AND has))"
    if policy == "replace":
        chunks_sql = "(SELECT count(*) FROM h WHERE document_id < '4' AND (has OR (document_id < '2' AND document_id NOT IN (SELECT document_id FROM h WHERE has))))"
    if policy == "rename":
        renamed = "document_id < '2' AND document_id IN (SELECT document_id FROM h WHERE has)"
        documents = f"{documents} + (SELECT count(*) FROM dd WHERE {renamed})"
        chunks_sql = f"{chunks_sql} + (SELECT count(*) FROM h WHERE {renamed} AND has)"
    return f"""WITH {_HELD}
SELECT CASE WHEN document_id < '2' THEN '{clash}' ELSE 'added' END AS action, count(*) AS documents, NULL::BIGINT AS chunks FROM dd WHERE document_id < '4' GROUP BY 1
UNION ALL SELECT 'total', {documents}, {chunks_sql}"""


POLICIES = ("skip", "replace", "merge", "rename")
QUERIES = {
    "index_build": index_build,
    **{f"index_search_{n}": partial(indexed, n) for n in SEARCHES},
    "index_changes": index_changes,
    "store_statistics": store_statistics,
    **{f"store_import_{p}": partial(store_import, p) for p in POLICIES},
    "store_export": store_export,
    "export_keys": export_keys,
    "embedded_repeats": embedded_repeats,
    "rerank_engine": rerank_engine,
}
SQL = {
    "index_build": f"WITH {_C} SELECT (SELECT count(DISTINCT document) FROM c) AS documents, n AS chunks, round(l, 6) AS mean_length FROM st",
    "index_search_or": _search([_count("archive"), _count("query"), _count("index")], "f0 + f1 + f2 > 0"),
    "index_search_phrase": _search([_phrase("audit", "trail"), _count("archive")], "f0 > 0 AND f1 > 0"),
    "index_search_not": _search([_count("snapshot"), _count("glossary")], "f0 + f1 > 0 AND NOT g", "len(list_filter(w, lambda x: starts_with(x, 'index'))) > 0 AS g"),
    "index_changes": f"""WITH c AS (SELECT {_D} AS document, batch_no FROM {_V} WHERE {_D} IS NOT NULL AND batch_no IS NOT NULL), l AS (SELECT document, max(batch_no > 20) AS late FROM c GROUP BY 1)
SELECT document, count(*) AS chunks FROM c JOIN l USING (document) WHERE (batch_no > 20) = late AND NOT starts_with(document, '0') GROUP BY 1""",
    "store_statistics": f"WITH {_HELD}, k AS (SELECT * FROM h WHERE NOT starts_with(document_id, '0')) SELECT count(DISTINCT document_id) AS documents, count(*) AS chunks, count(*) FILTER (has) AS embedded, CAST(max(CASE WHEN has THEN 64 END) AS INTEGER) AS dimension FROM k",
    **{f"store_import_{p}": _import_sql(p) for p in POLICIES},
    "store_export": f"""WITH {_HELD}, t AS (SELECT nullif(lower(trim(doc_id, ' ' || chr(9) || chr(10) || chr(13))), '') AS d, nullif(lower(trim(tag_name, ' ' || chr(9) || chr(10) || chr(13))), '') AS t FROM tag_suggestions WHERE lower(trim(status, ' ' || chr(9) || chr(10) || chr(13))) = 'confirmed'),
m AS (SELECT d, max(t IN ('topic/quinozon', 'quinozon')) AS hit, list_aggregate(list_sort(list_distinct(list(t))), 'string_agg', ',') AS tags FROM t WHERE d IS NOT NULL AND t IS NOT NULL GROUP BY 1),
r AS (SELECT document_id, unnest(x), CASE WHEN json_valid(x.metadata) THEN json_type(x.metadata) = 'OBJECT' END IS TRUE AS there FROM (SELECT {_D} AS document_id, arg_max({{path: path, filename: filename, file_type: file_type, file_size: file_size, content_hash: content_hash, indexed_at: indexed_at, metadata: metadata}}, record_id) AS x FROM document_records WHERE {_D} IS NOT NULL GROUP BY 1)),
o AS (SELECT *, CASE WHEN there THEN json_extract_string(metadata, '$.ragd_project') END AS project, CASE WHEN there THEN json_extract_string(metadata, '$.dc_title') END AS own_title,
 CASE WHEN regexp_matches(indexed_at, '([zZ]|[+-][0-9][0-9]:?[0-9][0-9])$') THEN TRY_CAST(indexed_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' ELSE TRY_CAST(indexed_at AS TIMESTAMP) END AS seen_at FROM r WHERE document_id IN (SELECT document_id FROM dd)),
p AS (SELECT project FROM o WHERE project <> '' GROUP BY 1 ORDER BY count(*) DESC, project LIMIT 1),
k AS (SELECT {_D} AS document_id, CASE WHEN json_valid(metadata) THEN CASE WHEN json_type(metadata) = 'OBJECT' THEN CAST(to_json(map_from_entries(list_transform(list_filter(json_keys(metadata), lambda x: x NOT IN ('document_id', 'chunk_id', 'content', 'chunk_index', 'embedding')), lambda x: {{k: x, v: metadata ->> ('$."' || x || '"')}}))) AS VARCHAR) END END AS kept FROM {_V}),
n AS (SELECT document_id, count(*) AS chunk_count, CAST(sum(length(coalesce(kept, '{{}}'))) AS BIGINT) AS metadata_characters FROM k GROUP BY 1),
e AS (SELECT 'tags' AS selection, document_id FROM dd LEFT JOIN m ON d = document_id WHERE coalesce(hit, true)
UNION ALL SELECT 'project', document_id FROM o WHERE NOT there OR coalesce(coalesce(project, '') = (SELECT project FROM p), true)
UNION ALL SELECT 'period', document_id FROM o WHERE seen_at BETWEEN TIMESTAMP '2024-03-01 00:00:00' AND TIMESTAMP '2024-05-31 23:59:59')
SELECT selection, document_id, coalesce(own_title, filename) AS title, path, nullif(lower(trim(content_hash, ' ' || chr(9) || chr(10) || chr(13))), '') AS content_hash, coalesce(tags, '') AS tags, seen_at AS indexed_at, chunk_count, file_type, file_size, metadata_characters
FROM e JOIN o USING (document_id) JOIN n USING (document_id) LEFT JOIN m ON d = document_id""",
    "export_keys": f"SELECT key, count(*) AS chunks FROM (SELECT unnest(json_keys(metadata)) AS key FROM {_V} WHERE json_valid(metadata) AND json_type(metadata) = 'OBJECT') WHERE key NOT IN ('page', 'strategy', 'document_id', 'chunk_id', 'content') GROUP BY 1",
}
