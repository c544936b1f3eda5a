import pytest
from pyspark.sql import functions as F

import __spark_entry__
from docweave.functions import keys, records


def test_entry_lists_agree():
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q) and all(callable(f) for f in q.values()) and {"p1_found", "p5_found", "hybrid_topk"} <= set(q)


@pytest.mark.parametrize("name,expected", [("Miller et al.", "miller"), ("Jane Doe and John Roe", "doe"), ("Roe, John", "roe"), ("  ", None), (None, None), ("A & B", "a")])
def test_surnames(spark, name, expected):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(records.surname("n")).first()[0] == expected


def test_dates_and_keys(spark):
    df = spark.createDataFrame([("2024-03-05",), ("March 5, 2024",), ("2024-03-05T10:00:00+02:00",), ("soon",), (None,)], "d string")
    got = [str(r[0]) if r[0] else None for r in df.select(records.any_date("d")).collect()]
    assert got == ["2024-03-05 00:00:00", "2024-03-05 00:00:00", "2024-03-05 08:00:00", None, None]
    k = spark.createDataFrame([(" A\t",), ("\n",), (None,)], "k string")
    assert [r[0] for r in k.select(keys.norm_key("k")).collect()] == ["a", None, None]
    i = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01 05:00:00",), ("2024-01-01T05:00:00.5-05:00",), ("x",)], "t string")
    assert [str(r[0]) if r[0] else None for r in i.select(keys.iso_instant("t")).collect()] == ["2024-01-01 00:00:00", "2024-01-01 05:00:00", "2024-01-01 10:00:00.500000", None]


def test_classes(spark):
    df = spark.createDataFrame([("Access denied: x",), ("cannot decode byte",), (None,), ("No such file",)], "m string")
    assert [r[0] for r in df.select(records.error_category("m")).collect()] == ["permission", "malformed", "unknown", "missing"]
    one = spark.createDataFrame([(0.9, 0.1, False, 0.0)], "c double, s double, t boolean, i double")
    assert one.select(records.pdf_class(F.col("c"), F.col("s"), F.col("t"), F.lit(False), F.col("i"))).first()[0] == "digital"
    ids = spark.createDataFrame([("ok-1",), ("",), ("a b",), ("x" * 99,)], "i string")
    assert [r[0] for r in ids.select(records.identifier_problem("i")).collect()] == [None, "empty", "characters", "too_long"]
    assert one.select(records.column_count(F.array(F.lit(10.0), F.lit(400.0)), F.lit(600.0))).first()[0] == 2
