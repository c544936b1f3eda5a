"""Measures over rankings, samples and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def histogram(rows: DataFrame, value: str, buckets: int) -> DataFrame:
    """(bucket, n): equal-width buckets from the smallest to the largest value, which falls into the last; empty buckets too.

    If all values are equal the width is 1. Null and NaN values are left out; an empty table gives buckets of 0.
    """
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ends = rows.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    width = F.when(F.col("__hi") > F.col("__lo"), (F.col("__hi") - F.col("__lo")) / buckets).otherwise(F.lit(1.0))
    placed = rows.join(F.broadcast(ends)).select(F.least(F.floor((F.col(value) - F.col("__lo")) / width), F.lit(buckets - 1)).cast("int").alias("bucket"))  # one row
    counts = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def compare(base: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, delta, percent, status) of (key, base) and (key, current): over 5 % more is a regression, over 5 % less an improvement."""
    j = base.join(current, key, "full_outer")
    percent = 100 * (F.col("current") - F.col("base")) / F.nullif("base", F.lit(0.0))
    status = F.when(F.col("base").isNull() | (F.col("base") == 0), "new").when(F.col("current").isNull(), "removed").when(percent > 5, "regression").when(percent < -5, "improvement").otherwise("stable")
    return j.select(key, F.round(F.col("current") - F.col("base"), 6).alias("delta"), F.round(percent, 4).alias("percent"), status.alias("status"))


def retrieval_metrics(ranked: DataFrame, k: int) -> DataFrame:
    """Precision, recall and nDCG at k, reciprocal rank and average precision of each query, of (query, rank, relevant).

    Measures without a relevant row are 0; rows with a null relevant count as not relevant.
    """
    hit = F.coalesce(F.col("relevant"), F.lit(False))
    w = Window.partitionBy("query").orderBy("rank")
    r = ranked.select("query", "rank", hit.alias("hit")).withColumn("found", F.sum(F.col("hit").cast("int")).over(w))
    near = F.col("hit") & (F.col("rank") <= k)
    total = F.sum(F.col("hit").cast("int"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(total, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return r.groupBy("query").agg(
        F.round(F.count_if(near) / F.lit(float(k)), 6).alias("precision"),
        zero(F.count_if(near) / F.nullif(total, F.lit(0))).alias("recall"),
        zero(1 / F.min(F.when(F.col("hit"), F.col("rank")))).alias("reciprocal_rank"),
        zero(F.sum(F.when(F.col("hit"), F.col("found") / F.col("rank"))) / F.nullif(total, F.lit(0))).alias("average_precision"),
        zero(F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1))) / F.when(total > 0, ideal)).alias("ndcg"),
    )


def decayed_mean(ranked: DataFrame, decay: float) -> DataFrame:
    """(query, relevance): the mean score weighted by decay to the power of the position."""
    weight = F.pow(F.lit(decay), F.col("rank") - 1)
    return ranked.groupBy("query").agg(F.round(F.sum(F.col("score") * weight) / F.sum(weight), 6).alias("relevance"))


def pack(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """(group, order, used): rows of each group in order while their sizes fit the budget, to the first that does not.

    Rows of size 0 fit as long as no row before them failed; null and negative sizes count as 0.
    """
    w = Window.partitionBy(group).orderBy(order)
    near = rows.withColumn(size, F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)))
    used = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("used", used).where(F.col("used") <= budget).select(group, order, "used")
