"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a random order, once for every allowed repetition. A document's virtual
finish time is the sum of its source's tokens up to and with it, divided by the source's weight. Taking
documents by finish time keeps every source at its share at any length, up to one document; the order is
cut at the total budget. A source that has run out simply has no later finish times.

Running sums are taken in two levels (sums of hash ranges, then within a range), so that a source with a
third of all rows is never in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.keys import norm_key
from docweave.llm.tokenize import encode_corpus
from docweave.session import Scratch

#: Hash ranges of a source; at most sources x RANGES partial sums are kept.
RANGES = 4096
#: Ranges of finish time that a slice is cut into; so many sums come to the driver.
SLICES = 1024
#: Copies that one task orders where the budget runs out.
ORDERED_HERE = 100_000
#: Targets are settings, one row a source; only these many are brought to the driver.
MOST_TARGETS = 10_000


class Mixture:
    """documents (key, source, text) in the shares of targets (source, target_share, max_repeats).

    Source labels compare trimmed and in lower case; documents of sources not listed, without a source or
    without tokens do not come out. Targets with a null or non-positive share or repeats count as absent; of a
    source listed twice the largest share and repeats hold. A listed source without documents gets nothing and
    the others keep their proportions. Without a budget the largest total is taken at which every listed source
    that has documents reaches its share within its repetitions. An empty table gives no rows.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", budget: int | None = None, seed: int = 0, scratch: Scratch | None = None):
        self.spark = documents.sparkSession
        self.scratch = scratch or Scratch(self.spark, "mixture")
        self.key = key
        wanted = targets.select(norm_key("source").alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("repeats"))
        wanted = wanted.where("source IS NOT NULL AND share > 0 AND repeats > 0 AND NOT isnan(share)")
        rows = wanted.groupBy("source").agg(F.max("share"), F.max("repeats")).limit(MOST_TARGETS + 1).collect()
        if len(rows) > MOST_TARGETS:
            raise ValueError(f"more than {MOST_TARGETS} target sources")
        self.targets = {r[0]: (float(r[1]), int(r[2])) for r in rows}
        named = documents.select(F.col(key).alias("key"), norm_key(source).alias("source"), F.col(text).alias("__text"))
        sized = encode_corpus(named.where(F.col("source").isin(list(self.targets))), "__text", count="tokens")
        turn = F.xxhash64(F.lit(seed), F.col("key").cast("string"))
        sized = sized.where("tokens > 0").select("key", "source", F.col("tokens").cast("bigint").alias("tokens"), turn.alias("turn"))
        self.sized = self.scratch.write("sizes", sized.withColumn("range", F.pmod(F.shiftright("turn", 40), F.lit(RANGES)).cast("int")))
        sums = self.sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
        self.held = {r["source"]: (r["tokens"], r["documents"]) for r in sums.collect()}  # one row a target
        share = sum(self.targets[s][0] for s in self.held)
        self.weight = {s: self.targets[s][0] / share for s in self.held}
        supply = {s: n * self.targets[s][1] for s, (n, _) in self.held.items()}
        self.budget = budget if budget is not None else min((int(n / self.weight[s]) for s, n in supply.items()), default=0)
        self.end = self._end(supply)

    def _end(self, supply: dict[str, int]) -> float:
        """The virtual time by which the budget is spent."""
        low, high = 0.0, max((n / self.weight[s] for s, n in supply.items()), default=0.0)
        for _ in range(100):
            mid = (low + high) / 2
            spent = sum(min(n, mid * self.weight[s]) for s, n in supply.items())
            low, high = (mid, high) if spent < self.budget else (low, mid)
        return high

    def _queue(self) -> DataFrame:
        """Every copy of a document that may begin before the end, with its finish time."""
        sums = self.sized.groupBy("source", "range").agg(F.sum("tokens").alias("sum"))
        earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        # the partial sums of a source are at most RANGES rows
        offsets = sums.select("source", "range", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
        within = Window.partitionBy("source", "range").orderBy("turn", "key").rowsBetween(Window.unboundedPreceding, 0)
        placed = self.sized.join(offsets, ["source", "range"]).withColumn("upto", F.col("before") + F.sum("tokens").over(within))
        settings = self.spark.createDataFrame([(s, self.held[s][0], self.weight[s], self.targets[s][1]) for s in self.held], "source string, all bigint, weight double, repeats int")
        placed = placed.join(F.broadcast(settings), "source")  # at most MOST_TARGETS rows
        # only passes that begin before the end: a pass is as long as the source
        passes = F.least(F.col("repeats"), F.ceil(F.lit(self.end) * F.col("weight") / F.col("all")).cast("int") + 1)
        copies = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(passes, F.lit(1)) - 1)))
        finish = (F.col("pass") * F.col("all") + F.col("upto")) / F.col("weight")
        copies = copies.withColumn("finish", finish).where((F.col("finish") - F.col("tokens") / F.col("weight")) <= F.lit(self.end * 1.001 + 1))
        return copies.select("key", "source", "pass", "tokens", "finish")

    def rows(self) -> DataFrame:
        """(key, source, copy, tokens, finish): the chosen copies; copy counts from 1."""
        if not self.held:
            return self.sized.select(F.col("key").alias(self.key), "source", F.lit(1).alias("copy"), "tokens", F.lit(0.0).alias("finish")).limit(0)
        queue = self.scratch.write("queue", self._queue())
        # the slice of finish times in which the budget runs out is cut again, until what one task orders is small
        low, width, spent, last = 0.0, max(self.end * 1.01 + 2, 1e-9), 0, False
        while True:
            step = width / SLICES
            inside = queue.where(F.col("finish") >= low) if low else queue
            number = F.least(F.greatest(F.floor((F.col("finish") - F.lit(low)) / F.lit(step)), F.lit(0)), F.lit(SLICES)).cast("int")
            sums = sorted((r[0], r[1], r[2]) for r in inside.where(F.col("finish") < low + width).groupBy(number).agg(F.sum("tokens"), F.count("*")).collect())  # at most SLICES + 1 rows
            hit = None
            for at, tokens, rows in sums:
                if spent + tokens > self.budget:
                    hit = (at, rows)
                    break
                spent += tokens
            if hit is None:
                break
            low, width, last = low + hit[0] * step, step, True
            if hit[1] <= ORDERED_HERE or step <= 1e-9 * max(self.end, 1.0):
                break
        whole = queue.where(F.col("finish") < low) if last else queue
        if last:
            order = Window.partitionBy(F.lit(1)).orderBy("finish", "source", "key", "pass").rowsBetween(Window.unboundedPreceding, 0)
            part = queue.where((F.col("finish") >= low) & (F.col("finish") < low + width)).withColumn("__sum", F.sum("tokens").over(order) + F.lit(spent))
            whole = whole.unionByName(part.where(F.col("__sum") <= self.budget).drop("__sum"))
        # in the order of their turn, by ranges
        return whole.orderBy("finish", "source", "key", "pass").select(F.col("key").alias(self.key), "source", (F.col("pass") + 1).alias("copy"), "tokens", "finish")

    def shares(self) -> DataFrame:
        """One row a target: its share, what it holds, and what it contributes."""
        used = self.rows().groupBy("source").agg(F.count("*").alias("copies"), F.max("copy").alias("most_repeats"), F.sum("tokens").alias("used_tokens"))
        wanted = [(s, share, repeats, self.held.get(s, (0, 0))[1], self.held.get(s, (0, 0))[0]) for s, (share, repeats) in self.targets.items()]
        base = self.spark.createDataFrame(wanted, "source string, target_share double, max_repeats int, documents bigint, tokens bigint")
        total = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))  # over the targets, one row a source
        joined = base.join(used, "source", "left").fillna(0, ["copies", "most_repeats", "used_tokens"])
        return joined.withColumn("actual_share", F.when(total > 0, F.col("used_tokens") / total).otherwise(F.lit(0.0)))
