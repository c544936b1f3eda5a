"""References to records that do not exist, were deleted, or arrive later.

Keys may be composite and partly null. References are grouped by their null mask; each mask is
anti-joined on its non-null columns, all masks in one shuffle: the referenced keys are projected on
the columns of every mask that may match, and references and projections meet on (mask, key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.skew import salted_join

SIMPLE, PARTIAL, FULL = "simple", "partial", "full"


def _mask(columns: list[str]) -> Column:
    """Bit i is set where column i is not null."""
    total = F.lit(0)
    for i, c in enumerate(columns):
        total = total + F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0))
    return total


def _joint(columns: list[str], mask: Column) -> Column:
    """One text for mask and key; every part has its length before it, so that no two keys run together."""
    parts = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in columns]
    return F.concat_ws("|", mask.cast("string"), *parts)


def orphan_references(
    refs: DataFrame,
    ref_keys: list[str],
    target: DataFrame,
    target_keys: list[str],
    match: str = SIMPLE,
    spread: str | None = None,
    born: str | None = None,
    dead: str | None = None,
    at: Column | None = None,
) -> DataFrame:
    """refs with a column orphan_reason: absent, deleted, later or mixed_null; rows that refer properly do not come out.

    match: as of SQL's MATCH clause. SIMPLE: a reference with any null part refers properly. PARTIAL: it
    must match a target on its non-null parts (all null: proper). FULL: all null is proper, partly null is an
    orphan of reason mixed_null.
    target: one or more rows a key; born and dead name columns of target: when the key entered and when it was
    deleted for good. A reference is deleted if each matched row has a dead, and later if the earliest born is in
    a later calendar month than at (an expression over refs); null born, dead or at give no verdict.
    spread: a column of refs that varies among the rows of a hot key.

    Nulls follow match; empty refs give no row; an empty target makes every complete reference absent; repeated
    rows of refs come out as often as they are there; repeated targets count once. Columns of refs keep their names.
    """
    n = len(ref_keys)
    full = (1 << n) - 1
    columns = [f"__k{i}" for i in range(n)]
    r = refs.withColumns({c: F.col(k) for c, k in zip(columns, ref_keys)}).withColumn("__mask", _mask(columns))
    t = target.select(
        *[F.col(k).alias(c) for c, k in zip(columns, target_keys)],
        (F.col(born) if born else F.lit(None).cast("timestamp")).alias("__born"),
        (F.col(dead) if dead else F.lit(None).cast("timestamp")).alias("__dead"),
    )
    # only the masks that references have: at most 2^n rows, a key having few columns
    masks = [m[0] for m in r.select("__mask").distinct().collect() if m[0]] or [full] if match == PARTIAL else [full]
    projections = F.explode(F.array(*[F.lit(m) for m in masks]))
    t = t.withColumn("__mask", projections)
    for i, c in enumerate(columns):
        t = t.withColumn(c, F.when(F.col("__mask").bitwiseAND(F.lit(1 << i)) != 0, F.col(c)))
    t = t.where(_mask(columns) == F.col("__mask"))
    t = t.select(_joint(columns, F.col("__mask")).alias("__key"), "__born", "__dead")
    t = t.groupBy("__key").agg(
        F.min("__born").alias("__born"),
        F.max("__dead").alias("__dead"),
        F.min(F.col("__dead").isNotNull()).alias("__gone"),
        F.lit(True).alias("__there"),
    )
    checked = F.col("__mask") == full if match != PARTIAL else F.col("__mask") != 0
    out = []
    if match == FULL:
        out.append(r.where((F.col("__mask") != 0) & (F.col("__mask") != full)).withColumn("orphan_reason", F.lit("mixed_null")))
    left = r.where(checked).withColumn("__key", _joint(columns, F.col("__mask")))
    joined = salted_join(left, t, "__key", "left", F.col(spread) if spread else F.monotonically_increasing_id())
    reason = F.when(F.col("__there").isNull(), "absent").when(F.col("__gone"), "deleted")
    if at is not None:
        reason = reason.when(F.date_trunc("month", "__born") > F.date_trunc("month", at.cast("timestamp")), "later")
    out.append(joined.withColumn("orphan_reason", reason).where(F.col("orphan_reason").isNotNull()))
    result = out[0] if len(out) == 1 else out[0].unionByName(out[1], allowMissingColumns=True)
    return result.select(*refs.columns, "orphan_reason")


def report_by_period(orphans: DataFrame, table: str, period: str) -> DataFrame:
    """Number of orphans per table, period and reason."""
    return orphans.groupBy(F.col(table).alias("table_name"), F.col(period).alias("period"), "orphan_reason").agg(F.count("*").alias("orphans"))
