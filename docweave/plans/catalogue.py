"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.plans import analytics, answering, collections_tree, edits, metadata, records, references, searching, stores, streams, texts

MODULES = (references, collections_tree, searching, metadata, analytics, texts, streams, records, stores, edits, answering)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["hybrid_topk"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
