from docweave.functions import html


def test_complexity_counts_over_the_whole_page(spark):
    late = "<main >" + "x" * 60_000 + "<iframe >" * 3
    df = spark.createDataFrame([(late,), ("<main >",), (None,)], "h string")
    assert [r[0] for r in df.select(html.complexity("h")).collect()] == ["complex", "simple", "moderate"]
