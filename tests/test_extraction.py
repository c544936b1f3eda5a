import re
import unicodedata

from pyspark.sql import functions as F

from docweave.functions import quality as q
from docweave.plans import texts

FIVE = "# A\n\n- b\n- c\n\n[x](y) and **bold** `code`\n| a | b |\n|---|---|\nFigure 3: a long enough caption ![i](j)"


def values(spark, text, *columns):
    df = spark.createDataFrame([(text, "pdf", 1000)], "t string, k string, n long")
    return [None if x is None else round(x, 6) for x in df.select(*[c.alias(str(i)) for i, c in enumerate(columns)]).first()]


def test_five_scores(spark):
    k, n = F.col("k"), F.col("n")
    five = lambda t, kind: values(spark, t, q.extraction_completeness("t", n, kind), q.extraction_characters("t"), q.extraction_structure("t", kind), q.extraction_images("t", kind), q.extraction_tables("t", kind))
    size = len(FIVE)
    control = sum(unicodedata.category(c)[0] == "C" for c in FIVE) / size
    assert control >= 0.01 and five(FIVE, k) == [round(0.7 + (size / 1000 - 0.02) / 0.48 * 0.3, 6), 0.95, 0.95, 0.9, 0.95]
    assert five("a" * 600, None)[1:] == [1.0, 0.3, 0.7, 0.6]
    assert five("a" * 600, F.lit("txt"))[1:] == [1.0, 0.5, 1.0, 1.0] and five("see [Table 2: x] ![a](b)", k)[3:] == [0.7, 0.7]
    assert five("", k) == [0.0] * 5
    assert values(spark, "��" + "a" * 98, q.extraction_characters("t")) == [0.5]
    assert values(spark, "x" * 20_000 + "\x02" * 1000, q.extraction_characters("t")) == [0.5]  # beyond the first 10 000 characters
    assert values(spark, "x", q.extraction_overall(*[F.lit(x) for x in (1.0, 0.8, 0.5, 0.7, 0.6)])) == [0.765]


def test_counts_as_in_python(spark):
    text = "Grün * x\n - y\n １. z\n_a_ __b__ *c* **d**\r\n# e\n\n```\n# f\n```\n1. g"
    want = [len(re.findall(p, text, re.MULTILINE)) for p in q.STRUCTURE]
    assert values(spark, text, *[q.count_matches("t", q._AS + p) for p in q.STRUCTURE]) == want


def test_indexed_text(spark):
    df = spark.createDataFrame([("# a\n\nÄpfel und Birnen\n\n- x", "äpfel birnen\n\n- x"), ("", "a"), ("...", ""), ("...", "a"), ("plain", "")], "s string, i string")
    assert [tuple(round(x, 4) for x in r) for r in df.select(q.word_coverage("s", "i"), q.structure_preservation("s", "i")).collect()] == [(0.6, 0.5), (0.0, 1.0), (1.0, 1.0), (0.0, 1.0), (0.0, 1.0)]


def test_confidence_completeness_formatting(spark):
    long = "word " * 120
    assert values(spark, "l1 O0 --- ABabC", q.extraction_confidence("t"), q.extraction_confidence("t", F.lit(True)), q.extraction_confidence("t", F.lit(True), F.lit(0.32))) == [0.92, 0.67, 0.3]
    assert values(spark, long, q.text_completeness("t"), q.text_completeness("t", F.lit(2000)), q.text_completeness("t", F.lit(800)), q.text_completeness("t", None, F.lit(True))) == [1.0, 0.5, 0.7, 0.7]
    assert values(spark, " " * 300 + "x", q.text_completeness("t")) == [0.3]
    assert values(spark, long, q.formatting_quality("t"), q.formatting_quality("t", F.lit(True), F.lit(True), F.lit(2)), q.formatting_quality("t", None, None, F.lit(9))) == [0.6, 0.75, 0.5]


def test_report(spark, tmp_path):
    spark.createDataFrame([(1, "d1", "TXT", 10), (2, "d2", "pdf", 100), (3, "d3", "pdf", 100), (4, "d1", "txt", 20)], "record_id long, document_id string, file_type string, file_size long").write.parquet(f"{tmp_path}/document_records.parquet")
    spark.createDataFrame([(2, "d1", "defghij"), (1, "d1", "abcdefghi"), (3, "d2", "x" * 20), (3, "d2", "x" * 20)], "vector_id long, document_id string, content string").write.parquet(f"{tmp_path}/vector_metadata.parquet")
    scores = {r["document"]: r for r in texts.extraction_scores(spark, str(tmp_path)).collect()}
    assert list(scores) == ["d2", "d1", "d3"] and scores["d3"]["overall"] is None
    assert [round(scores["d1"][x], 6) for x in ("completeness", "characters", "structure", "images", "tables", "overall")] == [0.85, 0.95, 0.55, 1.0, 1.0, 0.8525]
    rows = {(r["is_total"], r["file_type"]): r for r in texts.extraction_report(spark, str(tmp_path)).collect()}
    assert set(rows) == {(True, None), (False, "txt"), (False, "pdf")}
    assert [rows[True, None][x] for x in ("documents", "errors", "excellent", "good", "fair", "poor")] == [3, 1, 0, 2, 0, 0]
