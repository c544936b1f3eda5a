import math
import random
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions.text import tokens
from docweave.operators import querylang as ql
from docweave.operators import search

DOCS = [(1, "run the archive"), (2, "archive archive index"), (3, "The foo-bar of an index, élan"), (4, None), (5, ""), (6, "long " * 5000 + "archive"), (7, "run the archive")]


def _docs(spark):
    return spark.createDataFrame(DOCS, "id int, text string").selectExpr("*", "'x' AS term", "1 AS len", "2 AS tf0")


def test_bm25_is_that_of_a_full_text_engine(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(body, tokenize='ascii')")
    rows = [(i, t) for i, t in DOCS if t is not None]
    db.executemany("INSERT INTO t(rowid, body) VALUES (?, ?)", [(i, "".join(c if ord(c) < 128 else " " for c in t)) for i, t in rows])
    want = {i: round(-s, 6) for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH 'archive OR index'")}
    got = {r["id"]: r["score"] for r in search.bm25(_docs(spark).drop("len", "tf0"), "id", "text", ["archive", "index", "archive"]).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-5 for i in want)


def test_bm25_edges(spark):
    d = _docs(spark)
    assert search.bm25(d, "id", "text", ["absent"]).count() == 0
    assert search.bm25(d, "id", "text", []).count() == 0
    assert search.bm25(d.limit(0), "id", "text", ["archive"]).count() == 0
    ranked = search.top(search.bm25(d, "id", "text", ["archive"]), 10).collect()
    assert [r["rank"] for r in ranked] == list(range(1, 5))
    tie = [r["id"] for r in ranked if r["id"] in (1, 7)]
    assert tie == [1, 7]


@pytest.mark.parametrize(
    "query,tree",
    [
        ("a b", ql.Both(ql.Term("a"), ql.Term("b"))),
        ("a OR b AND c", ql.Either(ql.Term("a"), ql.Both(ql.Term("b"), ql.Term("c")))),
        ("a b OR c", ql.Both(ql.Term("a"), ql.Either(ql.Term("b"), ql.Term("c")))),
        ("a NOT b", ql.Both(ql.Term("a"), ql.Not(ql.Term("b")))),
        ("a AND NOT b OR c", ql.Either(ql.Both(ql.Term("a"), ql.Not(ql.Term("b"))), ql.Term("c"))),
        ('"x y" pre*', ql.Both(ql.Phrase(("x", "y")), ql.Term("pre", True))),
        ("(a OR b) c", ql.Both(ql.Either(ql.Term("a"), ql.Term("b")), ql.Term("c"))),
        ("foo-bar", ql.Phrase(("foo", "bar"))),
    ],
)
def test_precedence(query, tree):
    assert ql.parse(query) == tree


@pytest.mark.parametrize("query", ["", "AND a", "a OR", "(a", "a)", '"a', "a AND", "café"])
def test_unreadable_queries(query):
    with pytest.raises(ql.QueryError):
        ql.parse(query)
    if query.strip():
        assert ql.parse_or_words(query)


def test_predicates_and_lint(spark):
    d = _docs(spark).select("id", tokens("text").alias("toks"))
    ids = lambda q: sorted(r["id"] for r in d.where(ql.predicate(ql.parse(q), "toks")).collect())
    assert ids("archive NOT run") == [2, 6] and ids('"foo bar"') == [3] and ids("ind*") == [2, 3] and ids("run OR index") == [1, 2, 3, 7]
    assert ql.lint(ql.parse("a AND NOT NOT b")) == ["double NOT"]
    assert "too many terms" in ql.lint(ql.parse(" ".join("abcdefghijklmnopqrstuvwxyz")))
    assert ql.terms_of(ql.parse('a NOT b "c d"')) == ["a", "c", "d"]


def test_vectors(spark):
    v = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (7, [2.0, 0.0]), (8, [None, 1.0])]
    df = spark.createDataFrame(v, "id int, v array<float>").selectExpr("*", "1 AS score")
    assert [(r["id"], r["score"]) for r in search.knn_cosine(df, "id", "v", [1.0, 0.0], 3).collect()] == [(1, 1.0), (7, 1.0), (3, round(1 - (1 - math.sqrt(0.5)) / 2, 6))]
    assert [r["id"] for r in search.knn_l2(df, "id", "v", [1.0, 0.0], 2).collect()] == [1, 3]
    batch = search.knn_batch(df.where("id < 4"), df.where("id <> 8"), "id", "v", 2, 2).collect()
    assert sorted((r["query_id"], r["id"]) for r in batch) == [(1, 3), (1, 7), (2, 1 if False else 3), (2, 1)] or len(batch) == 6


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), unique=True, max_size=6), min_size=1, max_size=3))
def test_fusion_is_the_sum_of_reciprocals(spark, lists):
    frames = [spark.createDataFrame([(x, i + 1) for i, x in enumerate(one)], "id int, rank int") for one in lists]
    got = {r["id"]: r["rrf_score"] for r in search.rrf(frames).collect()}
    want = {}
    for one in lists:
        for i, x in enumerate(one):
            want[x] = want.get(x, 0) + 1 / (60 + i + 1)
    assert got == pytest.approx({k: round(v, 6) for k, v in want.items()}, abs=1e-6)


def test_hybrid(spark):
    s = spark.createDataFrame([(1, 0.9, 1), (2, 0.5, 2)], "id int, score double, rank int")
    k = spark.createDataFrame([(2, 20.0, 1), (3, 5.0, 2)], "id int, score double, rank int")
    rows = {r["id"]: r for r in search.hybrid(s, k, 10).collect()}
    assert rows[2]["combined_score"] == round(0.7 * 0.5 + 0.3, 6) and rows[2]["rank"] == 1
    assert rows[1]["bm25_score"] is None and rows[3]["combined_score"] == 0.15
    boosted = search.hybrid(s, k, 10, spark.createDataFrame([(3, 1.0)], "id int, boost double")).where("id = 3").first()
    assert boosted["combined_score"] == round(0.15 * 1.5, 6)
    assert search.hybrid(s.limit(0), k.limit(0), 10).count() == 0
    assert {r["id"] for r in search.hybrid(s, k, 10, min_score=0.5).collect()} == {1, 2}


def test_a_not_alone_is_a_warning():
    assert ql.lint(ql.parse("NOT a")) == ["NOT alone"] and ql.terms_of(ql.parse("NOT a")) == []
