"""Evaluation of answers and of an index, profiles of operations, health: further measures over samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The weights of an evaluation's measures in its overall score.
OVERALL = {"context_precision": 0.3, "context_recall": 0.2, "relevance": 0.2, "reciprocal_rank": 0.15, "ndcg": 0.15}


def context_recall(retrieved: Column, expected: Column) -> Column:
    """The share of the expected documents among the retrieved; 1 where none is expected."""
    e = F.array_distinct(F.coalesce(expected, F.array().cast("array<string>")))
    r = F.coalesce(retrieved, F.array().cast("array<string>"))
    return F.when(F.size(e) == 0, 1.0).otherwise(F.size(F.array_intersect(e, r)) / F.size(e))


def overall(weights: dict[str, float] | None = None) -> Column:
    """The weighted mean of the measures a row has; the weights of null ones go to the others; null where all are null."""
    w = weights or OVERALL
    total = sum((F.when(F.col(c).isNotNull(), F.lit(x)).otherwise(F.lit(0.0)) for c, x in w.items()), F.lit(0.0))
    return F.when(total > 0, F.round(sum((F.coalesce(F.col(c), F.lit(0.0)) * x for c, x in w.items()), F.lit(0.0)) / total, 6))


def graded_ndcg(ranked: DataFrame, k: int | None = None) -> DataFrame:
    """(query, ndcg) of (query, rank, score): graded gains, against the query's own scores in the best order; 0 for queries without a positive score."""
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rank"))
    r = ranked.where(F.col("score").isNotNull()).withColumn("__b", best)
    within = lambda c: F.col(c) <= k if k else F.lit(True)
    gain = lambda c: F.sum(F.when(within(c), F.col("score") / F.log2(F.col(c) + 1)).otherwise(F.lit(0.0)))
    return r.groupBy("query").agg(gain("rank").alias("d"), gain("__b").alias("i")).select("query", F.round(F.when(F.col("i") > 0, F.col("d") / F.col("i")).otherwise(F.lit(0.0)), 6).alias("ndcg"))


def session_summary(samples: DataFrame, operation: str, ms: str, memory: str) -> DataFrame:
    """One row an operation: count, total, mean, min, max, median and deviation (0 for one sample) of times, mean and max of the memory that is known."""
    q = lambda p: F.expr(f"percentile({ms}, {p})")
    return samples.where(F.col(ms).isNotNull()).groupBy(operation).agg(
        F.count("*").alias("count"),
        F.round(F.sum(ms), 6).alias("total_ms"),
        F.round(F.avg(ms), 6).alias("mean_ms"),
        F.min(ms).alias("min_ms"),
        F.max(ms).alias("max_ms"),
        F.round(q(0.5), 6).alias("median_ms"),
        F.round(F.coalesce(F.stddev_samp(ms), F.lit(0.0)), 6).alias("stdev_ms"),
        F.round(F.avg(memory), 6).alias("mean_memory"),
        F.max(memory).alias("max_memory"),
    )


def search_profile(samples: DataFrame, ms: str, results: str) -> DataFrame:
    """One row: searches, searches a second (0 without time) and the mean number of results."""
    total = F.sum(ms)
    return samples.agg(F.count(ms).alias("searches"), F.round(F.coalesce(F.when(total > 0, F.count(ms) / total * 1000), F.lit(0.0)), 6).alias("per_second"), F.round(F.coalesce(F.avg(results), F.lit(0.0)), 6).alias("mean_results"))


def index_evaluation(rows: DataFrame, score: str = "score") -> DataFrame:
    """(grade, documents, mean_score) of rows with a grade and a score, the whole as grade all."""
    g = rows.groupBy("grade").agg(F.count("*").alias("documents"), F.round(F.avg(score), 6).alias("mean_score"))
    return g.unionByName(rows.agg(F.lit("all").alias("grade"), F.count("*").alias("documents"), F.round(F.avg(score), 6).alias("mean_score")))


def report_change(reports: DataFrame, current: str, report: str, at: str, metrics: list[str]) -> DataFrame:
    """(metric, current, previous, change): the current report against the latest other one, for measures that both have."""
    long = reports.select(report, at, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select(report, at, "m.*")
    now = long.where(F.col(report) == current).select("metric", F.col("value").alias("current"))
    latest = reports.where(F.col(report) != current).agg(F.max_by(report, F.struct(at, report)).alias("__last"))
    before = long.join(F.broadcast(latest), F.col(report) == F.col("__last")).select("metric", F.col("value").alias("previous"))  # one row
    return now.join(before, "metric").where("current IS NOT NULL AND previous IS NOT NULL").withColumn("change", F.round(F.col("current") - F.col("previous"), 6))


def health(checks: DataFrame) -> DataFrame:
    """One row of checks (name, status, latency_ms): the worst status (error, warning, ok), how many of each, the largest latency; ok without checks."""
    level = F.when(F.col("status") == "error", 2).when(F.col("status") == "warning", 1).otherwise(0)
    r = checks.agg(F.max(level).alias("w"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "warning").alias("warnings"), F.count("*").alias("checks"), F.max("latency_ms").alias("slowest_ms"))
    return r.select(F.when(F.col("w") == 2, "error").when(F.col("w") == 1, "warning").otherwise("ok").alias("status"), "checks", "errors", "warnings", "slowest_ms")


def config_problems(settings: dict) -> list[tuple[str, str, str]]:
    """(setting, severity, problem) of weights that do not sum to 1, sizes that do not fit, and values out of range."""
    out = []
    weights = [v for k, v in settings.items() if k.endswith("_weight")]
    if weights and abs(sum(weights) - 1) > 1e-6:
        out.append(("weights", "error", f"they sum to {sum(weights):g}"))
    size, overlap = settings.get("chunk_size"), settings.get("overlap")
    if size is not None and size <= 0:
        out.append(("chunk_size", "error", "it is not positive"))
    elif size is not None and overlap is not None and overlap >= size:
        out.append(("overlap", "error", "it is not smaller than chunk_size"))
    elif size is not None and overlap is not None and overlap > size / 2:
        out.append(("overlap", "warning", "it is over half of chunk_size"))
    out += [(k, "error", "it is not within 0 and 1") for k, v in settings.items() if k.endswith(("_score", "_threshold")) and not 0 <= v <= 1]
    return out


def severity(problems: list[tuple[str, str, str]]) -> str:
    kinds = {s for _, s, _ in problems}
    return "error" if "error" in kinds else "warning" if kinds else "ok"
