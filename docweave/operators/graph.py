"""Entities of a fixed vocabulary, their co-occurrence graph, and what is near in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import tokens

#: A vocabulary of entities; its size bounds what one text can mention.
VOCABULARY = ("audit trail", "storage adapter", "query planner", "citation checker", "knowledge graph", "tag library", "chunk store", "access tier", "file parser", "style guide", "training corpus", "watch folder")
DECAY = 0.7


def mentions(texts: DataFrame, key: str, text: str, keep: list[str] = (), vocabulary: tuple[str, ...] = VOCABULARY) -> DataFrame:
    """(key, *keep, entity): which entities each text names, as whole words, once each. Null texts name none."""
    words = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    found = F.filter(F.array(*[F.lit(v) for v in vocabulary]), lambda v: F.contains(F.col("__w"), F.concat(F.lit(" "), v, F.lit(" "))))
    return texts.withColumn("__w", words).where(F.col("__w").isNotNull()).select(key, *keep, F.explode(found).alias("entity"))


def edges(mentioned: DataFrame) -> DataFrame:
    """(source, target, n, weight): pairs of entities of one text, source < target.

    A text's pairs come from the array of its entities, which the vocabulary bounds, and are counted before they are
    shuffled; weight is 1 + 0.1 x (n - 1), at most 1.
    """
    key = next(c for c in mentioned.columns if c != "entity")
    sets = mentioned.groupBy(key).agg(F.array_sort(F.collect_set("entity")).alias("e"))
    pair = F.flatten(F.transform("e", lambda x, i: F.transform(F.slice(F.col("e"), i + 2, F.greatest(F.size("e") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("source"), y.alias("target")))))
    rows = sets.select(F.explode(pair).alias("p")).select("p.source", "p.target")
    counted = rows.groupBy("source", "target").agg(F.count("*").alias("n"))
    return counted.withColumn("weight", F.least(F.lit(1.0), 1.0 + 0.1 * (F.col("n") - 1)))


def related(links: DataFrame, start: str, hops: int) -> DataFrame:
    """(entity, hops, score): what is reached from start in at most so many steps.

    The score is that of the best path of the fewest steps: the product of weights and of 0.7^hop for every step.
    """
    both = links.select("source", "target", "weight").unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    spark = links.sparkSession
    front = spark.createDataFrame([(start, 0, 1.0)], "entity string, hops int, score double")
    seen = front
    for hop in range(1, hops + 1):
        step = front.join(both, front["entity"] == both["source"]).select(F.col("target").alias("entity"), (F.col("score") * F.col("weight") * F.lit(DECAY**hop)).alias("score"))
        front = step.join(seen.select("entity"), "entity", "left_anti").groupBy("entity").agg(F.lit(hop).alias("hops"), F.max("score").alias("score"))
        seen = seen.unionByName(front)
    return seen.where(F.col("hops") > 0).select("entity", "hops", F.round("score", 6).alias("score"))
