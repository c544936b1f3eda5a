"""Structured Streaming over event tables and arriving files: windows, sessions, debounce, deletes, incremental ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.session import Scratch, table

LATENESS = "10 minutes"


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table of a folder as a stream; time stamps without zone become instants, which watermarks need."""
    schema = table(spark, sf_dir, name).schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 10).parquet(sf_dir)
    return raw.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) for each window; works on a batch and on a stream."""
    w = events.withWatermark("ts", LATENESS) if events.isStreaming else events
    g = w.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    """(user_id, start, n) for each run of events of a user without a pause of gap."""
    w = events.withWatermark("ts", LATENESS) if events.isStreaming else events
    g = w.where(F.col("user_id").isNotNull()).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("s.start").alias("start"), "n")


def run_to_end(stream: DataFrame, label: str, mode: str = "complete", apply: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote as a table.

    complete: the whole result of the last batch; append: all batches. Checkpoint and sink are in the shared folder, so that a
    restarted query goes on where it stopped and writes each batch once.
    """
    spark = stream.sparkSession
    scratch = Scratch(spark, f"stream-{label}")

    def write(batch: DataFrame, number: int) -> None:
        out = apply(batch) if apply else batch
        # a batch that runs again after a failure replaces what it wrote
        out.write.mode("overwrite").parquet(scratch.path(f"out/batch={number}" if mode == "append" else "out"))

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch.path("checkpoint")).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(scratch.path("out") if mode != "append" else scratch.path("out/batch=*"))


def debounced(events: DataFrame, key: str, quiet: str = "5 minutes", delete: str = "delete") -> DataFrame:
    """(key, at, n): the last event of each burst of a key, a burst ending after a quiet time or with a delete; those that end in a delete are dropped.

    The batch form of the debounce below.
    """
    seconds = F.lit(0) if not quiet else F.expr(f"INTERVAL {quiet}")
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    fresh = F.lag("ts").over(w).isNull() | (F.col("ts") - F.lag("ts").over(w) >= seconds) | F.coalesce(F.lag("event_type").over(w) == delete, F.lit(False))
    e = events.withColumn("__new", fresh.cast("int"))
    e = e.withColumn("__burst", F.sum("__new").over(w))
    last = e.groupBy(key, "__burst").agg(F.max_by(F.struct("ts", "event_type"), F.struct("ts", "event_id")).alias("l"), F.count("*").alias("n"))
    return last.where(F.col("l.event_type") != delete).select(key, F.col("l.ts").alias("at"), "n")


def debounce_stream(events: DataFrame, key: str, quiet_ms: int = 300_000, delete: str = "delete") -> DataFrame:
    """(key, at, n) as a stream: a key's state is its last event and count; an event-time timer emits it after the quiet time.

    A later event sets the timer anew, a delete cancels it.
    """
    shape = events.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, n = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "at": [pd.Timestamp(at, unit="us")], "n": [n]})
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last, n = state.get if state.exists else (None, 0)
        out = []
        for ts, kind in zip(rows["ts"], rows["event_type"]):
            now = int(ts.value // 1000) if ts.unit == "ns" else int(ts.as_unit("us").value)
            if last is not None and now - last >= quiet_ms * 1000:
                out.append((k[0], pd.Timestamp(last, unit="us"), n))
                n = 0
            last, n = (now, n + 1) if kind != delete else (None, 0)
        if last is None:
            if state.exists:
                state.remove()
        else:
            state.update((last, n))
            state.setTimeoutTimestamp(max(last // 1000 + quiet_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "at", "n"])

    grouped = events.withWatermark("ts", LATENESS).groupBy(key)
    return grouped.applyInPandasWithState(step, f"{key} {shape}, at timestamp, n long", "last long, n long", "append", "EventTimeTimeout")


def recent_ring(events: DataFrame, most: int = 100) -> DataFrame:
    """The newest events, most of them at most."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def ingest_step(target: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that upserts a batch of rows by key into a folder, and writes the batch only.

    Of several rows of a key in a batch the latest counts; a row whose event_type is delete removes its key. A batch made
    again takes its own place. live_rows() reads what is there.
    """

    def write(batch: DataFrame, number: int) -> None:
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_type")))
        newest = batch.where(F.col(key).isNotNull()).withColumn("__r", place).where("__r = 1").drop("__r")
        rows = newest.select("*", F.lit(number).cast("bigint").alias("__change"), (F.coalesce("event_type", F.lit("")) != "delete").alias("__live"))
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write


def live_rows(spark: SparkSession, target: str, key: str) -> DataFrame:
    """What ingest_step() has written: the rows of the latest change of each key, but for deleted ones."""
    rows = spark.read.parquet(target).drop("batch")
    last = rows.groupBy(key).agg(F.max(F.struct("__change", "__live")).alias("__last")).where("__last.__live").select(key, F.col("__last.__change").alias("__change"))
    return rows.where("__live").join(last, [key, "__change"], "left_semi").drop("__change", "__live")
