from pyspark.sql import functions as F

from docweave.functions import normalise
from docweave.operators import decompose as d


def test_decompose():
    assert [p.text for p in d.decompose("Parquet vs ORC for scans?")] == ["Parquet scans", "ORC scans"]
    assert [p.text for p in d.decompose("What is the difference between BM25 and TF-IDF?")] == ["BM25", "TF-IDF"]
    assert [p.kind for p in d.decompose("costs and risks of sharding")] == ["aspect", "aspect"]
    assert [p.text for p in d.decompose("index layout and also query speed")] == ["index layout", "query speed"]
    assert d.decompose("plain question") == [d.SubQuery("plain question", "whole")] and d.decompose("  ") == []
    assert len(d.decompose(" and ".join(f"part{i}" for i in range(9)))) == d.MOST_PARTS


def test_aggregate(spark):
    r = spark.createDataFrame([(0, "a", 1.0), (1, "a", 0.5), (1, "b", 0.8), (1, "c", None)], "part int, id string, score double")
    got = {h: {x["id"]: round(x["score"], 6) for x in d.aggregate(r, h).collect()} for h in ("max", "sum", "weighted")}
    assert got == {"max": {"a": 1.0, "b": 0.8}, "sum": {"a": 1.5, "b": 0.8}, "weighted": {"a": 0.625, "b": 0.8}}


def test_conversation(spark):
    assert d.references("What does the Miller report from 2019 say, and Smith (2020)?")[0][2] == 0.95
    assert d.references("the papers from 2018") == [("", "2018", 0.65)] and d.references("nothing") == []
    df = spark.createDataFrame([(0,), (100_000,), (4000,)], "chars long")
    h, c = d.token_budget(F.col("chars"), 4096, 1024, 0.3, 256, 512)
    assert [tuple(r) for r in df.select(h, c).collect()] == [(256, 2816), (921, 2151), (921, 2151)]
    rows = spark.createDataFrame([("d", 2, "s.md", "two", 5), ("d", 1, "s.md", "one", 3), ("d", 3, None, "end", None)], "doc string, o int, src string, txt string, p int")
    assert d.format_context(rows, "doc", "o", "src", "txt", "p").first()["text"] == "s.md, p. 3, 5\none\n[...]\ntwo\n[...]\nend"
    assert [r[0] for r in spark.createDataFrame([(1.0, 1.0), (0.5, 0.3)], "a double, b double").select(d.quality_band(F.col("a"), F.col("b"))).collect()] == ["excellent", "poor"]


def test_normalise(spark, tmp_path):
    words = {"hello", "world", "archive"}
    assert normalise.join_spaced_letters("H e l l o w x y z", words) == "H e l l o w x y z" and normalise.join_spaced_letters("say H e l l o.", words) == "say Hello."
    assert normalise.split_joined_words("thearchive hello archiveof xof", words) == "the archive hello archive of xof"
    assert normalise.expand_ligatures("eﬃcient ﬁle") == "efficient file"
    assert normalise.join_broken_lines("This line is long enough to be joined\nwith the next.\nNew one") == "This line is long enough to be joined with the next.\nNew one"
    text = "MENU\n\n" + "A real paragraph of some length with words. It has sentences. " * 3 + "\n\nHOME"
    assert normalise.main_content(text).startswith("A real") and "HOME" not in normalise.main_content(text)
    assert [normalise.classify_block(x) for x in ("", "- a\n- b", "| a |\n| b |", "Figure 3 shows", "Short title", "A sentence that is long enough to be content of a page, surely.")] == ["short", "list", "table", "caption", "heading", "content"]
    assert normalise.similarity("", "") == 1.0 and normalise.similarity("abc", "abd") > 0.6
    (tmp_path / "w.txt").write_text("Alpha\n\n beta \nALPHA\n")
    assert sorted(r[0] for r in normalise.word_list(spark, f"file://{tmp_path}/w.txt").collect()) == ["alpha", "beta"]
