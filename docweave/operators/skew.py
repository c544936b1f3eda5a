"""Joins on keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many keys are treated as hot; any key outside the most frequent MOST_HOT has under 1/MOST_HOT of the rows.
MOST_HOT = 100


#: Rows of a hot key that one part is to hold.
ROWS_A_PART = 100_000


def hot_keys(df: DataFrame, key: str, least_rows: int = 10_000) -> dict:
    """The most frequent non-null keys with at least least_rows rows, and how many: at most MOST_HOT of them, whatever the size of df."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    top = counts.where(F.col("count") >= least_rows).orderBy(F.desc("count"), key).limit(MOST_HOT)
    return {r[0]: r[1] for r in top.collect()}


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str, spread: Column, hot: dict | None = None) -> DataFrame:
    """left JOIN right on one key column of the same name, each hot key of left split into parts by its counted rows.

    A hot key has at least 16 parts, and one for every ROWS_A_PART rows; the rows of right that have it are repeated as often, so
    right should have few rows a key. hot: counts by key, counted here if not given.
    spread: an expression over left that varies among the rows of one key. how: inner, left, left_semi or left_anti.
    Null keys match nothing. With no hot key this is the plain join.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    parts = F.lit(1)
    for number in {max(16, -(-n // ROWS_A_PART)) for n in hot.values()}:
        keys = [k for k, n in hot.items() if max(16, -(-n // ROWS_A_PART)) == number]
        parts = F.when(F.col(key).isin(keys), F.lit(number)).otherwise(parts)
    salted_left = left.withColumn("__salt", F.pmod(F.xxhash64(spread), parts).cast("int"))
    salted_right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return salted_left.join(salted_right, [key, "__salt"], how).drop("__salt")
