import pytest
from pyspark.sql import functions as F

from docweave.functions import cleanup, html, layout, protect, schema
from docweave.operators import answers, engines, entities, measures, tagedits


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_verdicts(spark):
    rows = spark.createDataFrame([(0.3, None), (0.2, 0.8), (0.2, 0.6), (0.2, 0.1), (0.1, None), (0.9, None)], "s double, m double")
    got = [tuple(r[0]) for r in rows.select(answers.verdict(F.col("s"), F.col("m"))).collect()]
    assert got == [("valid", 0.6), ("valid", 0.8), ("weak", 0.6), ("weak", 0.4), ("invalid", 0.03), ("valid", 1.0)]


def test_overlap_counts_words_of_over_two_letters(spark):
    df = spark.createDataFrame([("The cat and Führung", "a cat, a fuhrung"), ("the of", "x"), (None, "x")], "c string, s string")
    assert [r[0] for r in df.select(answers.overlap("c", "s")).collect()] == [1.0, 0.0, 0.0]


def test_claims_and_citations(spark):
    a = spark.createDataFrame([(1, "First thing [1;2]. Second! Third [9]."), (2, None)], "q int, answer string")
    claims = answers.cited_claims(a, "q", "answer")
    assert {tuple(r) for r in claims.collect()} == {(1, 1, "First thing."), (1, 2, "First thing."), (1, 9, "Third.")}
    c = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "z")], "q int, citation int, content string")
    assert {r["citation"]: r["in_range"] for r in answers.joined_citations(claims, c, "q").collect()} == {1: True, 2: True, 9: False}
    assert [r["citation"] for r in answers.unused(c, claims, "q").collect()] == [3]


def test_cascade_and_correction(spark):
    full, none = spark.range(2), spark.range(0)
    asked = []

    def search(query, documents, least):
        asked.append((query, documents, least))
        return full if least < 0.5 else none

    got = answers.cascade(search, "q", "r", (["d"], 0.95))
    assert got.step == "lowered" and asked == [("q", ["d"], 0.5), ("r", None, 0.5), ("q", None, 0.5), ("q", None, 0.35)]
    assert answers.cascade(lambda *a: none, "q").step == "none"
    out = answers.correct(lambda q: (q, 0.1 * len(q)), lambda q, a: 0.5, lambda q: q + "+", lambda q, a: a + "!", "ab")
    assert out["rewrites"] == 2 and out["refinements"] == 1 and out["answer"] == "ab++!" and out["confidence"] == 0.46


def test_small_columns(spark):
    assert _one(spark, answers.winner(F.lit('{"score_a": 1, "score_b": 2}'))) == "B" and _one(spark, answers.winner(F.lit("no"))) == "tie"
    assert _one(spark, answers.prompt("Q: {q}\n{c}", q=F.lit("x"), c=F.lit(None))) == "Q: x\n"
    with pytest.raises(ValueError):
        answers.prompt("{q}")
    assert _one(spark, answers.summary(F.lit("One two. " + "x" * 100), 10)) == "One two."
    assert _one(spark, answers.category(F.lit(" Report. "), ["report"])) == "report" and _one(spark, answers.category(F.lit("x"), ["report"])) == "other"
    assert _one(spark, answers.contextual(F.lit("c"), F.lit(" head "))) == "head\n\nc" and _one(spark, answers.contextual(F.lit("c"), F.lit(None))) == "c"
    assert _one(spark, answers.score_in(F.lit("about 7 of 10"))) == 1.0 and _one(spark, answers.score_in(F.lit("none"))) is None


def test_references_and_recent(spark):
    refs = spark.createDataFrame([("q", "smith", "2020", 0.95), ("q", "", "2021", 0.65)], "question string, author string, year string, confidence double")
    docs = spark.createDataFrame([("d1", "smith", "2020", "smith-index.pdf"), ("d2", "lee", "2021", "tag-report.txt")], "document_id string, author string, year string, filename string")
    assert {tuple(r) for r in answers.resolved(refs, docs).collect()} == {("q", "d1", 0.95), ("q", "d2", 0.65)}
    asked = spark.createDataFrame([("what does the tag report say",)], "question string")
    assert [tuple(r)[1:] for r in answers.by_filename(asked, docs).collect()] == [("d2", 0.7)]
    turns = spark.createDataFrame([("s", 1, ["a", "b"]), ("s", 2, ["b", None, "c"])], "session string, turn int, cited array<string>")
    assert [r["document"] for r in answers.recent_documents(turns, "session", "turn", "cited", 2).orderBy("position").collect()] == ["b", "c"]


def test_tag_edits(spark):
    df = spark.createDataFrame([(1, ["B", " a ", None, ""]), (2, None)], "doc int, names array<string>").select("doc", tagedits.from_strings("names").alias("tags"))
    names = lambda c: [r[0] for r in df.select(tagedits.names_of(c)).orderBy("doc").collect()]
    assert names("tags") == [["a", "b"], []]
    assert names(tagedits.add("tags", F.array(tagedits.entry("A", "x"), tagedits.entry("C")))) == [["a", "b", "c"], ["a", "c"]]
    assert names(tagedits.remove("tags", ["B "])) == [["a"], []] and names(tagedits.remove("tags", source="legacy")) == [[], []]
    assert names(tagedits.rename("tags", "b", "a")) == [["a"], []]
    out = tagedits.edit(df, "doc", "tags", tagedits.remove("tags", ["b"]))
    assert [r["changed"] for r in out.orderBy("doc").collect()] == [True, False]


def test_collections_and_namespaces(spark):
    c = spark.createDataFrame([("1", "One", None), ("2", "Two", "1")], "id string, name string, parent_id string")
    assert [tuple(r) for r in tagedits.delete_collections(c, ["one"]).collect()] == [("2", "Two", None)]
    with pytest.raises(Exception, match="cannot be named"):
        tagedits.create_collections(c, spark.createDataFrame([("3", " one ", None)], c.schema)).collect()
    n = spark.createDataFrame([("sys", True, True, False, None)], "name string, is_open boolean, is_system boolean, is_hidden boolean, description string")
    v = spark.createDataFrame([("sys", "x")], "namespace string, tag_value string")
    n2, v2 = tagedits.create_namespace(n, v, " New ", False, ["P"])
    assert n2.count() == 2 and v2.count() == 2
    for bad in (("new", True, ["x"]), ("sys", False, [])):
        with pytest.raises(ValueError):
            tagedits.create_namespace(n, v, *bad)
    with pytest.raises(ValueError):
        tagedits.delete_namespace(n2, v2, "sys")
    assert tagedits.delete_namespace(n2, v2, "new")[0].count() == 1


def test_schema_versions(spark):
    old = '{"source_path": "/a/My-file.pdf", "file_type": "pdf", "content_hash": "h", "chunk_count": 3}'
    mid = '{"app_schema_version": "2.1", "app_tags": ["B", {"name": "a", "source": "llm"}], "app_sensitivity": "confidential", "dc_title": "T"}'
    df = spark.createDataFrame([(1, old), (2, mid), (3, "broken"), (4, None)], "id int, m string")
    got = {r["id"]: (r["from_version"], r["meta"]) for r in schema.migrated(df, "m", "app").collect()}
    assert got[1][0] == "1.0" and (got[1][1]["title"], got[1][1]["format"], got[1][1]["language"], got[1][1]["chunk_count"]) == ("My-file", "application/pdf", "en", 3)
    assert got[2][0] == "2.1" and got[2][1]["data_tier"] == "sensitive" and [(t["name"], t["source"]) for t in got[2][1]["tags"]] == [("a", "llm"), ("b", "legacy")]
    assert got[3][0] == got[4][0] == "2.2" and got[4][1]["tags"] == [] and got[4][1]["data_tier"] == "public"


def test_cleanup():
    words = {"some", "modern", "reader", "find", "the", "archive"}
    assert cleanup.fix_spelling("tbe rnodern Frorn reader", words) == "the modern From reader"
    assert cleanup.fix_ligatures("deiinition oﬃce iind", words) == "definition office find"
    page = "Home\nA real sentence about archives.\n--- footer ---\nhidden\n--- end ---\nShare this\n***\n42\nLeave a comment"
    assert cleanup.remove_boilerplate(page, "aggressive") == "A real sentence about archives."
    assert "Share this" in cleanup.remove_boilerplate(page, "conservative") and "Leave a comment" in cleanup.remove_boilerplate(page, "moderate")
    assert cleanup.remove_boilerplate("Listen\nText here is fine", "conservative", "medium.com") == "Text here is fine"
    got = cleanup.normalised("Figure 1: A view\nText  here​ ", "pdf", {}, words)
    assert got["text"] == "Text here" and "removed_captions" in got["changes_made"] and "removed_zero_width_chars" in got["changes_made"]
    assert cleanup.normalised("  a ", "pdf", {"enabled": False}, words)["text"] == "  a " and cleanup.normalised(None, None, {}, words) is None
    assert [b["type"] for b in cleanup.content_blocks("Home\n\n" + "A sentence of prose here. " * 6 + "\n\nTiny bit")] == ["navigation", "content", "short_text"]


def test_entities_and_keywords(spark):
    t = spark.createDataFrame([(1, "Python, python and C++ at Google; an API"), (2, None)], "id int, t string")
    got = {(r["name"], r["type"], r["confidence"]) for r in entities.extract(t, "id", "t").collect()}
    assert got == {("python", "technology", 0.85), ("c++", "technology", 0.85), ("google", "organisation", 0.9), ("api", "concept", 0.8)}
    k = spark.createDataFrame([(1, "alpha beta alpha beta gamma"), (2, "delta"), (3, None)], "id int, t string")
    first = {r["id"]: r["keyword"] for r in entities.keywords(k, "id", "t", 2).where("rank = 1").collect()}
    assert first[2] == "delta" and 3 not in first


def test_measures(spark):
    df = spark.createDataFrame([(["a"], ["a", "b"]), ([], []), (None, ["x"])], "got array<string>, want array<string>")
    assert [r[0] for r in df.select(measures.context_recall(F.col("got"), F.col("want"))).collect()] == [0.5, 1.0, 0.0]
    o = spark.createDataFrame([(1.0, None, 0.5, None, None), (None,) * 5], "context_precision double, context_recall double, relevance double, reciprocal_rank double, ndcg double")
    assert [r[0] for r in o.select(measures.overall()).collect()] == [0.8, None]
    assert measures.severity(measures.config_problems({"a_weight": 0.7, "b_weight": 0.2})) == "error" and measures.severity(measures.config_problems({"chunk_size": 10, "overlap": 6})) == "warning"


def test_layout(spark):
    blocks = spark.createDataFrame([(1, 0.0, 10.0, 5.0, "a"), (1, 60.0, 70.0, 0.0, "c"), (1, 0.0, 10.0, 9.0, "b")], "page int, x0 double, x1 double, y0 double, text string").withColumn("width", F.lit(100.0))
    ordered = layout.reading_order(layout.column_of(blocks, ["page"], "width"), ["page"])
    assert layout.page_text(ordered, ["page"]).first()["text"] == "a\n\nb\n\nc" and ordered.first()["columns"] == 2
    pages = spark.createDataFrame([("s", 1, 0, 1, 0.95, 0, 0, 1), ("d", 1, 900, 0, 0.0, 3, 0, 1)], "f string, page int, characters int, images int, image_share double, fonts int, tables int, columns int")
    q = {r["f"]: r["class"] for r in layout.file_quality(pages, "f").collect()}
    assert q == {"s": "scanned", "d": "digital_native"}


def test_pages():
    page = '<html lang="en"><head><meta content="T1" property="og:title"><link href="https://a.b/c" rel="canonical"></head><body><div class="x y" data-k="7"><b>Hi</b> <div>in</div></div><ul><li>one<li>two</ul><pre class="language-py">a &lt; b</pre></body></html>'
    assert html.select_first(page, "div.y[data-k=7]") == "Hi in" and html.select_first(page, "div", "data-k") == "7" and html.select_first(page, "p") is None and html.select_first(None, "p") is None
    parts = html.lists_and_code(page)
    assert parts == {"lists": ["- one\n- two"], "code": [{"language": "py", "code": "a < b"}]}
    data = '<html><script type="application/ld+json">{"articleBody": "' + "long text " * 20 + '"}</script><body></body></html>'
    assert html.read_page(data)["text"].startswith("long text")


def test_page_metadata(spark):
    page = '<meta content="T1" property="og:title"><link href="https://a.b/c" rel="canonical"><meta name="date" content="2024-03-01"><meta name="keywords" content="a, b,">'
    r = spark.createDataFrame([(page,), ("",)], "h string").select(*html.page_metadata("h")).collect()
    assert (r[0]["title"], r[0]["canonical"], str(r[0]["published"])[:10], r[0]["keywords"]) == ("T1", "https://a.b/c", "2024-03-01", ["a", "b"]) and r[1]["title"] is None


def test_encryption_and_session(spark):
    key = protect.derive_key("pw", b"salt")
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, content string")
    hidden = protect.encrypted(df, ["content"], key)
    assert hidden.first()["content"] != b"x" and [r["content"] for r in protect.decrypted(hidden, ["content"], key).collect()] == ["x", None]
    assert [r["id"] for r in protect.filter_encrypted(hidden, ["content"], key, {"content": "x"}).collect()] == [1]
    now = [0.0]
    s = protect.Session.for_password("pw", b"salt", clock=lambda: now[0], timeout=10, attempts=2, lockout=5)
    assert not s.active and s.unlock("pw") and s.active
    now[0] = 11
    assert not s.active and not s.unlock("no") and not s.unlock("no")
    with pytest.raises(PermissionError):
        s.unlock("pw")
    now[0] = 17
    assert s.unlock("pw")


def test_engines(spark):
    assert isinstance(engines.HashedEmbedder(), engines.Embedder) and isinstance(engines.OverlapReranker(), engines.Reranker)
    df = spark.createDataFrame([(1, "b c"), (2, "archive index"), (3, None)], "id int, t string").withColumn("rank", F.col("id"))
    out = engines.reranked(df, "archive", "t", engines.OverlapReranker, 2).orderBy("final_rank").collect()
    assert [(r["id"], r["original_rank"]) for r in out] == [(2, 2), (1, 1)]
    assert [r["id"] for r in engines.reranked(df, "x", "t", None, 2).orderBy("final_rank").collect()] == [1, 2]
    v = [r[0] for r in df.orderBy("id").select(engines.embedded("t", engines.HashedEmbedder)).collect()]
    assert len(v[0]) == 256 and v[2] is None
    class _Pages:
        def pages(self, data):
            if data == b"bad":
                raise ValueError("broken")
            yield 1, data.decode(), 0.9
            yield 2, "dim", 0.1

    files = spark.createDataFrame([("a", bytearray(b"text")), ("b", bytearray(b"bad"))], "path string, content binary")
    got = {(r["path"], r["page"], r["text"], r["error"]) for r in engines.read_pages(files, _Pages, least=0.5).collect()}
    assert got == {("a", 1, "text", None), ("b", None, None, "ValueError: broken")}
    i = spark.createDataFrame([("qwen2-7b-instruct-32k",), ("nomic-embed",)], "m string").select(engines.inferred("m").alias("i")).collect()
    assert (i[0]["i"]["family"], i[0]["i"]["parameters_b"], i[0]["i"]["context"]) == ("qwen", 7.0, 32768) and i[1]["i"]["type"] == "embedding"
    a = spark.createDataFrame([("m", 1, None)], "model string, size int, note string")
    b = spark.createDataFrame([("m", None, "x"), ("n", 2, "y")], "model string, size int, note string")
    assert {tuple(r) for r in engines.merged_metadata([a, b]).collect()} == {("m", 1, "x"), ("n", 2, "y")}
    assert engines.route("chat", {"a", "b"}, {"chat": "z"}, "a") == "a"
    with pytest.raises(LookupError):
        engines.route("chat", {"a"}, {}, override="z")
