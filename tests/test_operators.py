import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docweave.functions import chunks, html, pii, text
from docweave.operators import evaluation, graph, tagging
from docweave.operators.bits import BitFilter
from docweave.operators.filters import FilterError, compile_filter, tag_query, tag_query_text
from docweave.sources import files, store
from docweave.streaming import events as ev

META = ['{"page": 1, "lang": "en", "ok": true}', '{"page": 2.5}', '{"page": "3"}', "{broken", None, "", "{}", '{"lang": "de", "page": 7}']


def _python(where, row):
    """The filter by hand; None where a key is missing."""
    import json

    try:
        data = json.loads(row["metadata"]) if row["metadata"] else {}
    except ValueError:
        data = {}
    out = True
    for k, v in where.items():
        if k in ("$and", "$or"):
            parts = [_python(w, row) for w in v]
            r = (all(p is True for p in parts) if k == "$and" else any(p is True for p in parts))
        else:
            x = row[k] if k in ("id",) else data.get(k)
            ops = v if isinstance(v, dict) else {"$eq": v}
            r = True
            for op, y in ops.items():
                if op in ("$in", "$nin") and not y:
                    r = r and op == "$nin"
                elif x is None:
                    r = False
                else:
                    c = {"$eq": lambda: x == y, "$ne": lambda: x != y, "$gt": lambda: x > y, "$gte": lambda: x >= y, "$lt": lambda: x < y, "$lte": lambda: x <= y, "$in": lambda: x in y, "$nin": lambda: x not in y}
                    r = r and c[op]()
        out = out and r
    return out


@pytest.mark.parametrize("where", [{}, {"page": 1}, {"lang": {"$ne": "en"}}, {"page": {"$gt": 1, "$lte": 7}, "id": {"$gte": 1}}, {"$or": [{"lang": "en"}, {"id": 6}]}, {"lang": {"$in": []}}, {"lang": {"$nin": []}}, {"lang": {"$nin": ["en"]}}, {"ok": True}, {"$and": [{"lang": "de"}, {"$or": [{"page": 7}]}]}])
def test_filters_against_python(spark, where):
    rows = [(i, m) for i, m in enumerate(META) if m != META[2]]
    df = spark.createDataFrame(rows, "id int, metadata string").selectExpr("*", "'x' AS page2")
    got = sorted(r["id"] for r in df.where(compile_filter(where, ("id",))).collect())
    assert got == [i for i, m in rows if _python(where, {"id": i, "metadata": m}) is True]


def test_unknown_operator(spark):
    with pytest.raises(FilterError):
        compile_filter({"a": {"$near": 1}}, ())


def test_tag_queries_and_collections(spark):
    rows = spark.createDataFrame([("d1", "topic/a"), ("d1", "team/x"), ("d2", "topic/b_c"), ("d3", "topic/bxc")], "doc string, tag string")
    arrays = tagging.tag_arrays(rows)
    docs = lambda **q: sorted(r["doc"] for r in arrays.where(tag_query("tags", **q)).collect())
    assert docs() == ["d1", "d2", "d3"] and docs(include_all=["topic/*"], exclude=["team/*"]) == ["d2", "d3"]
    assert docs(include_any=["topic/b_*"]) == ["d2"] and docs(include_any=["*/x", "topic/bxc"]) == ["d1", "d3"]
    c = spark.createDataFrame([("c1", ["topic/*"], None, ["team/x"]), ("c2", [], ["*_c", "topic/a"], []), ("c3", None, None, None), ("c4", ["topic/a", "team/*"], [], None)], "id string, include_all array<string>, include_any array<string>, exclude array<string>")
    got = sorted((r["collection"], r["doc"]) for r in tagging.collection_members(rows, c).collect())
    assert got == [("c1", "d2"), ("c1", "d3"), ("c2", "d1"), ("c2", "d2"), ("c4", "d1")]
    assert tag_query_text(["a"], ["b", "c"], ["d"]) == "a AND (b OR c) AND NOT d"


def test_tiers(spark):
    df = spark.createDataFrame([("public",), (" Critical",), (None,), ("odd",), ("sensitive",)], "tier string")
    got = [tuple(r) for r in df.select(tagging.tier_level("tier"), tagging.step_tier("tier", 1), tagging.can_access(tagging.tier_level("tier"), True, False)).collect()]
    assert got == [(0, "personal", True), (3, None, False), (1, "sensitive", True), (1, "sensitive", True), (2, "critical", True)]


def test_measures(spark):
    r = spark.createDataFrame([("q", 1, False), ("q", 2, True), ("q", 3, None), ("q", 4, True), ("z", 1, False)], "query string, rank int, relevant boolean").withColumn("score", F.lit(1.0))
    m = {x["query"]: x for x in evaluation.retrieval_metrics(r, 3).collect()}
    assert m["q"]["precision"] == round(1 / 3, 6) and m["q"]["recall"] == 0.5 and m["q"]["reciprocal_rank"] == 0.5 and m["q"]["average_precision"] == 0.5
    assert m["z"]["ndcg"] == 0 and m["z"]["recall"] == 0
    assert [x["n"] for x in evaluation.histogram(spark.createDataFrame([(1.0,), (1.0,), (None,), (2.0,)], "v double"), "v", 3).orderBy("bucket").collect()] == [2, 0, 1]
    packed = evaluation.pack(spark.createDataFrame([("s", 1, 5), ("s", 2, 6), ("s", 3, 1)], "g string, o int, n int"), "g", "o", "n", 10)
    assert [x["o"] for x in packed.collect()] == [1]


def test_graph(spark):
    t = spark.createDataFrame([(1, "The audit trail and the query planner"), (2, "Query Planner, style-guide"), (3, None), (4, "audit trails")], "id int, text string")
    m = graph.mentions(t, "id", "text")
    assert sorted(map(tuple, m.collect())) == [(1, "audit trail"), (1, "query planner"), (2, "query planner"), (2, "style guide")]
    near = graph.related(graph.edges(m), "audit trail", 3).collect()
    assert {r["entity"]: (r["hops"], r["score"]) for r in near} == {"query planner": (1, 0.7), "style guide": (2, round(0.7 * 0.49, 6))}


def test_text_functions(spark):
    df = spark.createDataFrame([("a​b  c \n\n\n\n d\r\n",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.universal_fixes("t")).collect()] == ["ab c\n\nd", None, ""]
    one = spark.createDataFrame([("docu-\nment is\nhere", "HTTPS://www.A.org:80/x", "/a/my_file-one.txt")], "t string, u string, f string")
    r = one.select(text.html_line_breaks("t"), text.url_domain("u"), text.title_from_filename("f"), text.shorten(F.lit("a  b" * 9), 10)).first()
    assert tuple(r) == ("document is here", "a.org", "My File One", "a ba ba...")
    p = spark.createDataFrame([("mail a.b@c.org or 10.0.0.1",), (None,)], "t string")
    assert [x[0] for x in p.select(pii.masked("t")).collect()] == ["mail █████████ or ████████", None]
    assert [tuple(x) for x in p.select(*pii.counts("t", ["EMAIL_ADDRESS", "IP_ADDRESS"])).collect()] == [(1, 1), (0, 0)]


@pytest.mark.parametrize("strategy", list(chunks.STRATEGIES))
def test_chunks_cover_the_text_in_order(strategy):
    rnd = random.Random(3)
    for t in ["", "  ", "One. Two! Three? " * 40, "# Head\n\nPara one.\n\n" * 20, "x" * 3000, "".join(rnd.choice("ab .\nA") for _ in range(1500))]:
        c = chunks.chunk(t, strategy, 32, 4, 8)
        assert [x["index"] for x in c] == list(range(len(c)))
        assert all(x["content"] == t[x["start"] : x["stop"]] for x in c)
        assert all(a["start"] < b["start"] for a, b in zip(c, c[1:]))
        covered = set()
        for x in c:
            covered.update(range(x["start"], x["stop"]))
        assert all(i in covered or t[i].isspace() for i in range(len(t)))
        if strategy == "fixed":
            assert all(x["tokens"] <= 32 for x in c)
    assert chunks.chunk(None) is None


# (strategy, text, size, least, expected pieces), written by hand from the rules
CHUNKS = [
    ("recursive", "aaaa bbbb\n\ncccc dddd\n\neeee", 3, 1, ["aaaa bbbb\n\n", "cccc dddd\n\neeee"]),
    ("recursive", "aaaa bbbb\n\ncc", 3, 2, ["aaaa bbbb\n\ncc"]),
    ("recursive", "aaaaaaaaaaaaaaaaaaaa", 2, 1, ["aaaaaaaaaaaaaaaaaaaa"]),
    ("recursive", "One here.\n## Two\nmore", 3, 1, ["One here.\n", "## Two\nmore"]),
    ("structure", "# A\nshort one\n\n# B\nother text here", 8, 1, ["# A\nshort one\n\n", "# B\nother text here"]),
    ("structure", "# A\n\n```\nx\n\ny\n```\n\ntail tail tail tail", 5, 0, ["# A\n\n```\nx\n\ny\n```", "tail tail tail tail"]),
    ("elements", "# A\n\none two three\n\nfour five six", 6, 0, ["# A\n\none two three\n\n", "four five six"]),
]


@pytest.mark.parametrize("strategy,text_,size,least,pieces", CHUNKS)
def test_pieces_by_rule(strategy, text_, size, least, pieces):
    assert [x["content"] for x in chunks.chunk(text_, strategy, size, 0, least)] == pieces


def test_pages(spark):
    page = "<html><head><title> T </title><script>var x='no';</script></head><body><nav>menu</nav><main><h2>Head &amp; more</h2><p>Some body text here.</p><table><tr><td>a</td><td>b</td></tr></table></main></body></html>"
    r = html.read_page(page)
    assert r["text"] == "Head & more\nSome body text here.\na\nb" and r["headings"] == [{"level": 2, "title": "Head & more"}] and r["tables"] == ["| a | b |"]
    assert html.read_page(None) is None and html.read_page("")["text"] == ""
    df = spark.createDataFrame([(page,), ("<p>x",), (None,)], "h string")
    assert [x[0] for x in df.select(html.best_title("h")).collect()] == ["T", None, None]
    assert df.select(html.page_column("h").alias("p")).where("p.text IS NOT NULL").count() == 2


def test_files(spark, tmp_path):
    import io
    import zipfile

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "sub" / "b.md").write_text("# hi")
    (tmp_path / "c.bin").write_text("no")
    (tmp_path / "d.docx").write_bytes(b"broken")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "e.docx").write_bytes(z.getvalue())
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.extract_files(files.discover(spark, str(tmp_path))).collect()}
    assert got["a.txt"]["text"] == "é" and got["b.md"]["text"] == "# hi" and got["e.docx"]["text"] == "Hello" and "c.bin" not in got
    assert not got["d.docx"]["success"] and got["d.docx"]["error"]
    ok = spark.createDataFrame([("/x/a.md", 5), ("/tmp/a.md", 5), ("/x/a.py", 5), ("/x/b.md", 1 << 30)], "p string, n long")
    assert [r[0] for r in ok.select(files.should_index(F.col("p"), F.col("n"), ["*.md"], ["/tmp/*"])).collect()] == ["ok", "excluded", "not_included", "too_large"]


def test_store(spark, tmp_path):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, v string")
    b = spark.createDataFrame([("2", "z"), ("3", "w")], "id string, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(store.merge_policy(a, b, "id", "skip")) == [("1", "x"), ("2", "y"), ("3", "w")]
    assert rows(store.merge_policy(a, b, "id", "replace")) == [("1", "x"), ("2", "z"), ("3", "w")]
    assert rows(store.merge_policy(a, b, "id", "rename")) == [("1", "x"), ("2", "y"), ("2_imported", "z"), ("3", "w")]
    assert rows(store.changed(a, b, "id", ["v"])) == [("1", "removed"), ("2", "changed"), ("3", "new")]
    assert rows(store.differences(a, b, "id")) == [("1", "missing"), ("3", "extra")]
    where = f"file://{tmp_path}/arc"
    store.export_archive({"docs": a, "none": b.limit(0)}, where)
    back = store.import_archive(spark, where)
    assert rows(back["docs"]) == rows(a) and back["none"].count() == 0
    b.write.mode("overwrite").parquet(f"{where}/docs")
    with pytest.raises(ValueError):
        store.import_archive(spark, where)


def test_stream_is_the_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rnd = random.Random(4)
    rows = [(i, t0 + timedelta(minutes=rnd.randrange(3000)), rnd.randrange(5), rnd.choice(["view", "delete"]), 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1)
    df.write.parquet(f"file://{tmp_path}/events.parquet")
    stream = lambda: ev.event_stream(spark, f"file://{tmp_path}")
    batch = spark.read.parquet(f"file://{tmp_path}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream_rows = ev.run_to_end(ev.tumbling(spark.readStream.schema(batch.schema).parquet(f"file://{tmp_path}/events.parquet"), "6 hours"), "w")
    assert sorted(map(tuple, stream_rows.collect())) == sorted(map(tuple, ev.tumbling(batch, "6 hours").collect()))
    d = ev.run_to_end(ev.debounce_stream(spark.readStream.schema(batch.schema).parquet(f"file://{tmp_path}/events.parquet"), "user_id", 3_600_000), "d", "append")
    got, whole = set(map(tuple, d.collect())), set(map(tuple, ev.debounced(batch, "user_id", "1 HOUR").collect()))
    assert got <= whole and len(whole - got) <= 5


def test_bit_filter_misses_no_key(spark):
    keys = spark.range(0, 1000, 3)
    seen = spark.range(1000).where(BitFilter(keys, "id").maybe("id"))
    assert keys.join(seen, "id", "left_anti").count() == 0 and seen.count() < 400
    assert spark.range(10).where(BitFilter(keys.limit(0), "id").maybe("id")).count() == 0
