"""Tables in Parquet folders: upserts, deletes, archives with checksums, and checks between two stores."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SKIP, REPLACE, RENAME = "skip", "replace", "rename"


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """old with the rows of new in place of those with their keys; of several new rows of a key the last by order (or any one)."""
    last = new.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order) if order else F.lit(1)))).where("__r = 1").drop("__r")
    return old.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """old without the rows of the given keys; null keys delete nothing."""
    return old.join(keys.select(key).distinct(), key, "left_anti")


def merge_policy(store: DataFrame, incoming: DataFrame, key: str, policy: str, suffix: str = "_imported") -> DataFrame:
    """store with incoming: rows under a known key are skipped, take its place, or come in under a new key."""
    if policy == SKIP:
        return store.unionByName(delete(incoming, store, key))
    if policy == REPLACE:
        return upsert(store, incoming, key)
    if policy == RENAME:
        known = store.select(F.col(key).alias("__k")).distinct()
        renamed = incoming.join(known, F.col(key) == F.col("__k"), "left").withColumn(key, F.when(F.col("__k").isNotNull(), F.concat(key, F.lit(suffix))).otherwise(F.col(key))).drop("__k")
        return store.unionByName(renamed)
    raise ValueError(f"unknown policy {policy}")


def export_archive(tables: dict[str, DataFrame], folder: str) -> dict:
    """Writes tables as zstd Parquet with a manifest of their rows and a checksum that does not depend on row order."""
    manifest = {}
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
        manifest[name] = checksum(df.sparkSession.read.parquet(f"{folder}/{name}"))
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return manifest


def checksum(df: DataFrame) -> dict:
    """Number of rows, and the sum of the rows' hashes."""
    r = df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("sum")).first()
    return {"rows": r["rows"], "sum": str(r["sum"] or 0)}


def import_archive(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an archive; ValueError where one does not have the rows that the manifest says."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    out = {}
    for name, expected in manifest.items():
        if "/" in name or name.startswith("."):
            raise ValueError(f"unsafe table name {name}")
        out[name] = spark.read.parquet(f"{folder}/{name}")
        if checksum(out[name]) != expected:
            raise ValueError(f"table {name} is not what the manifest says")
    return out


def differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that one of two stores lacks."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("extra")))


def remaining(all_files: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """What a checkpoint of finished files leaves to do."""
    return delete(all_files, done, key)


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): new, removed or changed between two snapshots; the rest does not come out."""
    o = old.select(key, F.struct(*columns).alias("__o"))
    n = new.select(key, F.struct(*columns).alias("__n"))
    j = o.join(n, key, "full_outer")
    change = F.when(F.col("__o").isNull(), "new").when(F.col("__n").isNull(), "removed").when(~F.col("__o").eqNullSafe(F.col("__n")), "changed")
    return j.select(key, change.alias("change")).where("change IS NOT NULL")
