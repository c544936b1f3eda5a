from datetime import datetime

from pyspark.sql import functions as F

from docweave.operators import skew
from docweave.operators.orphans import FULL, PARTIAL, SIMPLE, orphan_references, report_by_period
from docweave.plans.references import deletions, documents_alive


def _refs(spark):
    rows = [(1, "a", 1), (2, "a", None), (3, None, None), (4, "x", 9), (5, None, 1), (6, "x", None), (6, "x", None), (7, "a|1", 2)]
    return spark.createDataFrame(rows, "id int, k1 string, k2 int").withColumns({"__key": F.lit("clash"), "key": F.lit("c")})


def _target(spark):
    return spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), (None, 3)], "t1 string, t2 int")


def _run(spark, match):
    out = orphan_references(_refs(spark).drop("__key"), ["k1", "k2"], _target(spark), ["t1", "t2"], match, spread="id")
    return sorted((r["id"], r["orphan_reason"]) for r in out.collect())


def test_masks_follow_the_declared_match(spark):
    assert _run(spark, SIMPLE) == [(4, "absent"), (7, "absent")]
    assert _run(spark, PARTIAL) == [(4, "absent"), (6, "absent"), (6, "absent"), (7, "absent")]
    assert _run(spark, FULL) == [(2, "mixed_null"), (4, "absent"), (5, "mixed_null"), (6, "mixed_null"), (6, "mixed_null"), (7, "absent")]


def test_empty_tables(spark):
    refs, target = _refs(spark).drop("__key"), _target(spark)
    assert orphan_references(refs.limit(0), ["k1", "k2"], target, ["t1", "t2"]).count() == 0
    assert orphan_references(refs, ["k1"], target.limit(0), ["t1"], spread="id").count() == 6


def test_life_span_and_report(spark):
    t = lambda m, d: datetime(2024, m, d)
    target = spark.createDataFrame([("a", t(1, 5), None), ("b", t(3, 1), None), ("c", t(1, 1), t(2, 1))], "k string, born timestamp, dead timestamp")
    refs = spark.createDataFrame([(1, "a", t(1, 1)), (2, "b", t(2, 28)), (3, "b", t(3, 31)), (4, "c", t(1, 2)), (5, "b", None), (6, "z", None)], "id int, k string, at timestamp")
    out = orphan_references(refs, ["k"], target, ["k"], spread="id", born="born", dead="dead", at=F.col("at"))
    assert sorted((r["id"], r["orphan_reason"]) for r in out.collect()) == [(2, "later"), (4, "deleted"), (6, "absent")]
    report = report_by_period(out.withColumns({"t": F.lit("x"), "m": F.lit("2024-01")}), "t", "m").collect()
    assert sum(r["orphans"] for r in report) == 3


def test_deletes_and_indexing_times(spark):
    audit = spark.createDataFrame(
        [("delete", " A ", "success", None, datetime(2024, 2, 1)), ("delete", "b", "success", '{"dry_run":true}', datetime(2024, 2, 1)), ("delete", "b", "failed", "{}", datetime(2024, 2, 1)), ("delete", None, "success", "{}", datetime(2024, 2, 1))],
        "operation string, target string, result string, details string, ts timestamp_ntz",
    )
    assert [r["key"] for r in deletions(audit).where("key IS NOT NULL").collect()] == ["a"]
    records = spark.createDataFrame([("A", "2024-01-31T23:30:00-01:00"), ("a\n", "2024-01-01 00:00:00"), ("b", "nonsense"), (None, "2024-01-01")], "document_id string, indexed_at string")
    alive = {r["key"]: r for r in documents_alive(records, audit).collect()}
    assert alive["a"]["dead"] is None and str(alive["a"]["born"]) == "2024-01-01 00:00:00"
    assert alive["b"]["born"] is None and set(alive) == {"a", "b"}


def test_salted_join_is_the_plain_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), (None, 4)], "k string, v int")
    assert skew.hot_keys(left, "k", 1000) == {"hot": 2000}
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = skew.salted_join(left, right, "k", how, F.col("id"), hot={"hot": 2000})
        b = left.join(right, "k", how)
        assert a.count() == b.count() and a.exceptAll(b.select(*a.columns)).count() == 0
