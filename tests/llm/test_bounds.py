import pytest

from docweave.llm import splitting


def test_settings_beyond_the_bound_are_an_error(spark):
    rows = spark.createDataFrame([(1, "a", "{}")], "id long, text string, metadata string")
    config = lambda n: spark.range(n).selectExpr("concat('s', id) AS strategy", "4 AS chunk_size", "0 AS overlap")
    with pytest.raises(ValueError):
        splitting.with_limits(rows, config(splitting.MOST_SETTINGS + 1))
    assert splitting.with_limits(rows, config(2)).count() == 1
