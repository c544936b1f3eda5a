import json
import re
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docweave.functions.stem import index_words, stem
from docweave.operators import documents
from docweave.operators.documents import DocumentStore, unsafe_member
from docweave.operators.keyindex import KeywordIndex
from docweave.plans import stores
from docweave.session import Scratch, shared_folder
from docweave.streaming import events

# what the published algorithm makes of these words
STEMS = "caresses:caress ponies:poni feed:feed agreed:agre motoring:motor conflated:conflat sized:size hopping:hop failing:fail happy:happi relational:relat conditional:condit digitizer:digit triplicate:triplic hopeful:hope goodness:good allowance:allow adjustable:adjust adoption:adopt probate:probat cease:ceas controlling:control running:run"


def test_stems():
    assert {w: stem(w) for w, _ in (x.split(":") for x in STEMS.split())} == dict(x.split(":") for x in STEMS.split())
    assert index_words("Élan FOO-bar_baz  Führung") == ["elan", "foo", "bar", "baz", "fuhrung"] and index_words(None) == []


def test_keyword_index_life(spark, tmp_path):
    rows = [("a", "a1", "He was running the archive index"), ("a", "a2", "élan of the archive"), ("b", "b1", "foo-bar archive"), ("c", "c1", None), (None, "x", "archive"), ("b", "b1", "foo-bar archive")]
    df = spark.createDataFrame(rows, "document string, chunk string, text string").selectExpr("*", "1 AS tf", "2 AS term")
    ix = KeywordIndex(spark, f"file://{tmp_path}/ix")
    assert ix.search("archive").count() == 0 and ix.statistics() == (0, 0, 0.0)
    ix.add(df)
    assert ix.statistics()[:2] == (3, 4)
    hits = lambda q, **k: [r["chunk"] for r in ix.search(q, **k).orderBy("rank").collect()]
    assert hits("run") == ["a1"] and hits("elan") == ["a2"] and hits('"foo bar"') == ["b1"] and hits("foo-bar") == ["b1"]
    assert set(hits("archive")) == {"a1", "a2", "b1"} and hits("archive", documents=["b"]) == ["b1"] and len(hits("archive", documents=[])) == 3
    assert hits("archive NOT foo* NOT elan") == ["a1"] and hits("") == [] and hits("NOT archive") == [] and hits('"bar foo"') == []
    reopened = KeywordIndex(spark, f"file://{tmp_path}/ix")
    reopened.add(spark.createDataFrame([("a", "a9", "nothing here")], "document string, chunk string, text string"))
    assert [r["chunk"] for r in reopened.search("archive").collect()] == ["b1"]
    assert reopened.delete(spark.createDataFrame([("b",), ("zz",)], "document string")) == 1 and reopened.search("archive").count() == 0
    there = {r["document"]: r["there"] for r in reopened.exists(spark.createDataFrame([("a",), ("b",), (None,)], "document string")).collect()}
    assert there == {"a": True, "b": False}
    reopened.compact()
    assert reopened.statistics()[:2] == (2, 2)


def _chunks(spark, rows):
    return spark.createDataFrame(rows, "document_id string, position int, content string, embedding array<float>").selectExpr("*", "'q' AS path")


def test_document_store(spark, tmp_path):
    store = DocumentStore(spark, f"file://{tmp_path}/s", dim=2)
    assert store.statistics().first()["documents"] == 0
    docs = spark.createDataFrame([("a", "/a.txt", "h1"), ("b", "/b.txt", "h2"), ("bare", "/c.txt", "h3"), (None, "/d", "h")], "document_id string, path string, content_hash string")
    store.add(docs, _chunks(spark, [("a", 0, "x", [1.0, 0.0]), ("a", 1, "y", None), ("b", 0, "z", [0.0, 1.0]), ("a", 0, "x", [1.0, 0.0])]))
    assert tuple(store.statistics().first()) == (2, 3, 2, 2)
    assert store.find_by_hash("h2").first()["document_id"] == "b" and store.find_by_hash("none").isEmpty()
    store.add(docs.where("document_id = 'a'"), _chunks(spark, [("a", 0, "new", [1.0, 1.0])]))
    assert sorted(r["content"] for r in store.held_chunks().collect()) == ["new", "z"]
    assert store.update(spark.createDataFrame([("a", "/moved", 1), ("zz", "/no", 1)], "document_id string, path string, unknown int")) == 1
    assert store.documents.live().where("document_id = 'a'").first()["path"] == "/moved"
    with pytest.raises(PySparkException):
        store.add(docs, _chunks(spark, [("a", 0, "x", [1.0])]))
    other = DocumentStore(spark, f"file://{tmp_path}/o", dim=2)
    assert store.copy_to(other, dry_run=True)["same"] is None and other.statistics().first()["documents"] == 0
    assert store.copy_to(other)["same"]
    assert store.delete_chunks(spark.createDataFrame([("b_chunk_0",)], "chunk_id string")) == 1
    assert store.delete(docs.where("document_id IN ('a', 'zz')")) == {"documents": 1, "chunks": 1}
    plan = store.import_archive(other.documents.live(), other.held_chunks(), "rename", stamp="7")
    assert {(r["document_id"], r["imported_as"], r["action"]) for r in plan.collect()} == {("a", "a", "added"), ("b", "b_imported_7", "renamed")}
    with pytest.raises(ValueError):
        store.import_archive(other.documents.live(), other.held_chunks(), "rename")


def test_unsafe_members(spark):
    rows = [("/etc/x", None), ("a/../../x", None), ("a/b", "../c"), ("a/b", "c"), ("C:\\x", None)]
    df = spark.createDataFrame(rows, "p string, l string")
    assert [r[0] for r in df.select(unsafe_member("p", F.col("l"))).collect()] == ["absolute", "parent", "link", None, "absolute"]


def test_ingest_step_writes_changes(spark, tmp_path):
    step = events.ingest_step(f"file://{tmp_path}/t", "k")
    batch = lambda rows: spark.createDataFrame(rows, "k string, ts int, event_type string")
    step(batch([("a", 1, "new"), ("b", 1, "new"), ("a", 2, "more"), (None, 1, "new")]), 0)
    for _ in range(2):
        step(batch([("b", 3, "delete"), ("c", 3, "new")]), 1)
    assert {(r["k"], r["ts"]) for r in events.live_rows(spark, f"file://{tmp_path}/t", "k").collect()} == {("a", 2), ("c", 3)}


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """The tables of sf0.001 with keys beyond 32 bits, for Spark and for SQL."""
    folder, sql = tmp_path_factory.mktemp("far"), duckdb.connect()
    keys = {"vector_metadata": "vector_id", "document_records": "record_id", "tag_suggestions": "id"}
    for name in [*keys, "chunk_embeddings"]:
        moved = f"REPLACE ({k} + 7000000000 AS {k})" if (k := keys.get(name)) else ""
        sql.sql(f"COPY (SELECT * {moved} FROM '/root/testdata/sf0.001/{name}.parquet') TO '{folder}/{name}.parquet'")
        sql.sql(f"CREATE VIEW {name} AS FROM '{folder}/{name}.parquet'")
    return str(folder), sql


def _as_sql(spark, far, name):
    folder, sql = far
    got = [tuple(r) for r in stores.QUERIES[name](spark, folder).collect()]
    assert got and sorted(got, key=str) == sorted(sql.sql(stores.SQL[name]).fetchall(), key=str)


def test_store_export_of_large_keys(spark, far):
    _as_sql(spark, far, "store_export")


def test_store_import_rename_of_large_keys(spark, far):
    _as_sql(spark, far, "store_import_rename")


def test_store_import_skip_of_large_keys(spark, far):
    _as_sql(spark, far, "store_import_skip")


def test_store_import_merge_of_large_keys(spark, far):
    _as_sql(spark, far, "store_import_merge")


def test_store_import_replace_of_large_keys(spark, far):
    _as_sql(spark, far, "store_import_replace")


def test_store_statistics_of_large_keys(spark, far):
    _as_sql(spark, far, "store_statistics")


def _leaves_its_rows_only(spark, far, name):
    shared = Path(shared_folder(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    assert stores.QUERIES[name](spark, far[0]).collect()
    assert {p.name for f in set(shared.iterdir()) - before for p in f.iterdir()} == {"result"}


def test_store_add_takes_chunks_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = _chunks(spark, [("a", 0, "x", None), ("a", 0, "x", None), ("a", None, "p", None), ("a", None, "p", None), ("a", 1, "y", [1.0, 0.0]), ("z", 0, "o", None), (None, 0, "n", None)])
    store = DocumentStore(spark, f"file://{tmp_path}/s", dim=2)
    store.add(spark.createDataFrame([("a",), ("b",)], "document_id string"), rows.mapInArrow(counted, rows.schema))
    assert seen.value == 7 and tuple(store.statistics().first()) == (1, 3, 1, 2)
    assert store.documents.live().first()["chunk_count"] == 3
    assert sorted((str(r["chunk_id"]), r["content"]) for r in store.chunks.live().collect()) == [("None", "p"), ("a_chunk_0", "x"), ("a_chunk_1", "y")]
    assert {p.name for p in (tmp_path / "s").iterdir()} == {"chunks", "documents"}


def test_store_import_rename_leaves_its_rows_only(spark, far):
    _leaves_its_rows_only(spark, far, "store_import_rename")


def test_store_import_skip_leaves_its_rows_only(spark, far):
    _leaves_its_rows_only(spark, far, "store_import_skip")


def test_store_import_merge_leaves_its_rows_only(spark, far):
    _leaves_its_rows_only(spark, far, "store_import_merge")


def test_store_import_replace_leaves_its_rows_only(spark, far):
    _leaves_its_rows_only(spark, far, "store_import_replace")


def test_store_statistics_leaves_its_rows_only(spark, far):
    _leaves_its_rows_only(spark, far, "store_statistics")


def _row_groups(folder):
    """(rows, bytes) of the row groups of all files below a folder."""
    files = [pq.ParquetFile(p).metadata for p in Path(folder).rglob("*.parquet")]
    return [(g.num_rows, g.total_byte_size) for m in files for g in map(m.row_group, range(m.num_row_groups))]


def test_store_writes_small_row_groups(spark, tmp_path):
    # one task has 24 MB of text to write
    rows = spark.range(0, 6000, 1, 1).selectExpr("cast(id div 60 as string) AS document_id", "id AS position", "array_join(transform(sequence(1, 32), j -> sha2(concat(id, '-', j), 512)), '') AS content")
    store = DocumentStore(spark, f"file://{tmp_path}/s")
    store.add(rows.select("document_id").distinct(), rows.repartition(1))
    for folder in ("chunks", "compacted"):
        if folder == "compacted":
            store.chunks.compact()
        found = _row_groups(store.chunks.folder.removeprefix("file://"))
        assert sum(n for n, _ in found) == 6000 and max(b for _, b in found) < 1.25 * documents.ROW_GROUP


def _in_small_row_groups(spark, monkeypatch, name):
    """The stores that a query drops hold its rows in row groups of the size that is set."""
    found, drop = [], Scratch.drop

    def look(self, table):
        found.extend(_row_groups(self.path(table).removeprefix("file://")))
        drop(self, table)

    monkeypatch.setattr(documents, "ROW_GROUP", 1 << 16, raising=False)
    monkeypatch.setattr(Scratch, "drop", look)
    assert stores.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    assert sum(b for _, b in found) > 1 << 20 and max(b for n, b in found if n > 200) < 3 << 16


def test_store_import_skip_in_small_row_groups(spark, monkeypatch):
    _in_small_row_groups(spark, monkeypatch, "store_import_skip")


def test_store_import_merge_in_small_row_groups(spark, monkeypatch):
    _in_small_row_groups(spark, monkeypatch, "store_import_merge")


def test_store_import_replace_in_small_row_groups(spark, monkeypatch):
    _in_small_row_groups(spark, monkeypatch, "store_import_replace")


def test_store_statistics_in_small_row_groups(spark, monkeypatch):
    _in_small_row_groups(spark, monkeypatch, "store_statistics")


def _exchanges(df, column):
    """How many exchanges of a plan without broadcasts carry a column."""
    spark, name = df.sparkSession, "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(df.select("*")._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set(name, before)
    inputs = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert inputs
    return sum(column in x for x in inputs)


def test_store_import_merge_shuffles_held_chunks_twice(spark, tmp_path, monkeypatch):
    store = DocumentStore(spark, f"file://{tmp_path}/s", dim=2)
    docs = spark.createDataFrame([("a", "/a"), ("b", "/b"), ("gone", "/g")], "document_id string, path string")
    store.add(docs, _chunks(spark, [("a", 0, "x", [1.0, 0.0]), ("a", 1, "y", None), ("b", 0, "z", None), ("gone", 0, "g", None)]))
    store.documents.delete(docs.where("document_id = 'gone'"))
    assert sorted(r["content"] for r in store.held_chunks().collect()) == ["x", "y", "z"]
    taken = []
    with monkeypatch.context() as m:
        m.setattr(DocumentStore, "add", lambda self, documents, chunks: taken.append(chunks))
        new = _chunks(spark, [("a", 0, "new", [1.0, 1.0]), ("c", 0, "c", [1.0, 1.0])]).selectExpr("*", "concat(document_id, '_chunk_', position) AS chunk_id")
        store.import_archive(spark.createDataFrame([("a", "/a2"), ("c", "/c")], "document_id string, path string"), new, "merge")
    assert sorted(r["content"] for r in taken[0].collect()) == ["c", "new", "y"]
    # the incoming chunks move once, by document; the held ones by their change and by their name
    assert _exchanges(taken[0], "content") == 3
    assert sorted(r["content"] for r in store.held_chunks(docs.where("document_id <> 'b'")).collect()) == ["x", "y"]


def test_store_import_replace_finds_latest_changes_without_sorting(spark, tmp_path):
    store = DocumentStore(spark, f"file://{tmp_path}/s", dim=2)
    rows = _chunks(spark, [("a", 0, "x", None), ("b", 0, "y", None)])
    store.add(rows.select("document_id"), rows)
    again = _chunks(spark, [("a", 0, "new", [1.0, 0.0])]).withColumn("chunk_id", F.lit("a_chunk_0"))
    store.import_archive(again.select("document_id"), again, "replace")
    # a change that has rows and a deletion of one key is live
    store.documents.delete(rows.select("document_id").where("document_id = 'b'"), 7)
    store.documents.put(rows.select("document_id").where("document_id = 'b'"), 7)
    assert sorted(r["content"] for r in store.held_chunks().collect()) == ["new", "y"]
    store.documents.delete(rows.select("document_id").where("document_id = 'b'"), 8)
    held = store.held_chunks()
    assert [r["content"] for r in held.collect()] == ["new"]
    assert "SortAggregate" not in spark._jvm.PythonSQLUtils.explainString(held._jdf.queryExecution(), "simple")


def test_store_statistics_loads_without_sorting_scanned_rows(spark, monkeypatch):
    taken = []
    with monkeypatch.context() as m:
        m.setattr(DocumentStore, "add", lambda self, documents, chunks: taken.append(chunks))
        stores._loaded(spark, "/root/testdata/sf0.001", Scratch(spark, "store"), "s")
    lines = spark._jvm.PythonSQLUtils.explainString(taken[0]._jdf.queryExecution(), "simple").splitlines()
    scans = [i for i, x in enumerate(lines) if "FileScan parquet" in x]
    assert len(scans) == 2
    for i in scans:
        above = next(j for j in range(i, -1, -1) if "Exchange" in lines[j])
        assert not any("Sort" in x for x in lines[above:i])


def test_store_statistics_in_row_groups_of_4_mb(spark, tmp_path):
    # one task has 24 MB of text to write
    rows = spark.range(0, 6000, 1, 1).selectExpr("cast(id div 60 as string) AS document_id", "id AS position", "array_join(transform(sequence(1, 32), j -> sha2(concat(id, '-', j), 512)), '') AS content")
    store = DocumentStore(spark, f"file://{tmp_path}/s")
    store.add(rows.select("document_id").distinct(), rows.repartition(1))
    store.delete(rows.where("document_id LIKE '9%'"))
    assert tuple(store.statistics().first())[:2] == (89, 5340)
    assert 4 << 20 > max(b for _, b in _row_groups(store.chunks.folder.removeprefix("file://"))) * 0.8


def test_export_filter_takes_all_metadata_of_a_document(spark):
    docs = spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01'), ('b', timestamp'2024-01-02'), ('c', timestamp'2024-01-03'), ('bare', NULL) t(document_id, indexed_at)")
    rows = [("a", ["x"], "p"), ("a", ["y", None], "q"), ("b", ["y"], "q"), ("b", ["x"], "p"), ("c", None, None), (None, ["x"], "p")]
    metadata = spark.createDataFrame(rows, "document_id string, tags array<string>, project string").coalesce(1)
    of = lambda **k: sorted(r["document_id"] for r in documents.export_filter(docs, metadata, **k).collect())
    day = lambda n: F.lit(f"2024-01-0{n}").cast("timestamp")
    assert of(tags=["x"]) == of(tags=["y"]) == of(project="p") == of(project="q") == ["a", "b", "bare"]
    assert of(tags=["x"], project="q") == ["a", "b", "bare"] and of(tags=["none"]) == of(project="none") == ["bare"]
    assert of() == of(project="", tags=[]) == ["a", "b", "bare", "c"]
    assert of(since=day(2)) == ["b", "c"] and of(until=day(2), tags=["x"]) == ["a", "b"] and of(since=day(2), until=day(2)) == ["b"]


def test_store_export_does_its_whole_job(spark, far):
    key = lambda x: (x or "").strip().lower()
    characters, project, seen = defaultdict(int), {}, set()
    for v in pq.read_table(f"{far[0]}/vector_metadata.parquet").to_pylist():
        try:
            kept = json.loads(v["metadata"])
        except (TypeError, ValueError):
            kept = {}
        if v["vector_id"] not in seen:
            characters[key(v["document_id"])] += len(json.dumps({k: str(x) for k, x in kept.items()}, separators=(",", ":"), ensure_ascii=False))
        seen.add(v["vector_id"])
    for r in sorted(pq.read_table(f"{far[0]}/document_records.parquet").to_pylist(), key=lambda r: r["record_id"]):
        project[key(r["document_id"])] = json.loads(r["metadata"]).get("ragd_project", "") if r["metadata"] else None
    got = stores.QUERIES["store_export"](spark, far[0]).collect()
    of = {s: [r for r in got if r["selection"] == s] for s in ("tags", "project", "period")}
    assert all(of.values()) and sum(map(len, of.values())) == len(got) == len({(r["selection"], r["document_id"]) for r in got})
    assert all(r["metadata_characters"] == characters[r["document_id"]] for r in got)
    assert {project[r["document_id"]] for r in of["project"]} - {None} and len({project[r["document_id"]] for r in of["project"]} - {None}) == 1
    assert all((2024, 3) <= (r["indexed_at"].year, r["indexed_at"].month) <= (2024, 5) for r in of["period"])
