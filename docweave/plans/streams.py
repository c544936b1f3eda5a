"""Streaming queries, run over all that has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.session import table
from docweave.streaming import events as ev


def stream_window(spark: SparkSession, d: str) -> DataFrame:
    return ev.run_to_end(ev.tumbling(ev.event_stream(spark, d)), "window").withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return ev.run_to_end(ev.sessions(ev.event_stream(spark, d)), "session").withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_debounce(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of each user's events; those still open when the stream ends have not been emitted."""
    return ev.run_to_end(ev.debounce_stream(ev.event_stream(spark, d).where("user_id IS NOT NULL"), "user_id", 3_600_000, "signup"), "debounce", "append")


def batch_debounce(spark: SparkSession, d: str) -> DataFrame:
    return ev.debounced(table(spark, d, "events").where("user_id IS NOT NULL"), "user_id", "1 HOUR", "signup")


def recent_events(spark: SparkSession, d: str) -> DataFrame:
    return ev.recent_ring(table(spark, d, "events")).select("event_id", "ts", "event_type")


QUERIES = {"stream_window": stream_window, "stream_session": stream_session, "stream_debounce": stream_debounce, "batch_debounce": batch_debounce, "recent_events": recent_events}
SQL = {
    "stream_window": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_session": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "batch_debounce": """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR AND coalesce(lag(event_type) OVER w <> 'signup', true) THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e),
l AS (SELECT user_id, k, max(ts) AS "at", arg_max(event_type, (ts, event_id)) AS kind, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, "at", n FROM l WHERE kind <> 'signup'""",
    "recent_events": "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
}
