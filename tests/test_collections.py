from docweave.operators import tagging

SCHEMA = "id string, include_all array<string>, include_any array<string>, exclude array<string>"


def results(spark, collections):
    rows = spark.createDataFrame([("d1", "topic/a"), ("d1", "team/x"), ("d2", "topic/b"), ("d3", "team/y")], "doc string, tag string")
    docs = spark.createDataFrame([(f"d{i}",) for i in range(1, 5)], "doc string")  # d4 has no tag
    c = spark.createDataFrame(collections, SCHEMA)
    sizes = {r["collection"]: r["members"] for r in tagging.collection_sizes(rows, c, docs).collect()}
    of = {r["doc"]: (r["collections"], r["first_collection"]) for r in tagging.collections_for_doc(rows, c, docs).collect()}
    return sizes, of, sorted(tuple(r) for r in tagging.exclusions(rows, c).collect())


def test_collections_that_include_by_no_tag(spark):
    sizes, of, out = results(spark, [("a", None, [], ["team/*", "topic/a"]), ("b", [], None, ["team/x"]), ("c", ["topic/*"], None, None), ("d", None, None, None), ("e", None, None, ["none/*"]), ("f", ["none"], [], [])])
    assert sizes == {"a": 2, "b": 3, "c": 2, "d": 4, "e": 4, "f": 0}
    assert of == {"d1": (3, "c"), "d2": (5, "a"), "d3": (3, "b"), "d4": (4, "a")}
    assert out == [("a", "d1"), ("a", "d3"), ("b", "d1")]


def test_every_collection_excludes(spark):
    sizes, of, _ = results(spark, [("a", [], [], ["team/*"]), ("b", [], [], ["topic/*"]), ("c", [], [], ["team/x"])])
    assert sizes == {"a": 2, "b": 2, "c": 3}
    assert of == {"d2": (2, "a"), "d3": (2, "b"), "d4": (3, "a")}  # d1 is in none


def test_no_such_collection(spark):
    sizes, of, out = results(spark, [("c", ["topic/*"], None, ["team/*"])])
    assert (sizes, of, out) == ({"c": 1}, {"d2": (1, "c")}, [])


def test_queries_list_them(spark, tmp_path):
    from docweave.plans import metadata

    spark.createDataFrame([("a", [], [], ["t*"], None, None, None), ("b", ["u"], [], [], None, None, None)], SCHEMA + ", created_at timestamp, parent_id string, name string").write.parquet(f"{tmp_path}/collections.parquet")
    spark.createDataFrame([("D1",), ("d2",)], "document_id string").write.parquet(f"{tmp_path}/document_records.parquet")
    spark.createDataFrame([("d1", "t1", "confirmed"), ("d3", "u", "confirmed")], "doc_id string, tag_name string, status string").write.parquet(f"{tmp_path}/tag_suggestions.parquet")
    run = lambda name: sorted(tuple(r) for r in metadata.QUERIES[name](spark, str(tmp_path)).collect())
    assert run("collection_sizes") == [("a", 2), ("b", 1)] and run("collection_members") == [("a", None), ("b", "d3")]
    assert run("collection_exclusions") == [("a", "d1")] and run("collections_for_doc") == [("d2", 1, "a"), ("d3", 2, "a")]
