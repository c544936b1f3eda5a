"""Metadata records from version to version: 1.0 (plain keys), 2.0 (Dublin Core), 2.1 (sensitivity, embedding), 2.2 (tags with sources, tiers).

A record is a JSON object. Keys other than Dublin Core's have a prefix of the application in version 2 and above, which is cut
off here, so that one set of columns serves every version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.keys import as_column, iso_instant
from docweave.operators.tagedits import ENTRY, tidy

CURRENT = "2.2"
# File types and their media types; sensitivities and their tiers.
MEDIA = {"pdf": "application/pdf", "txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "html": "text/html", "htm": "text/html"}
TIER_OF = {"public": "public", "internal": "personal", "confidential": "sensitive"}


def parsed(metadata: str | Column) -> Column:
    return F.try_parse_json(as_column(metadata))


def pick(record: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(record, f"$.{key}", kind)


def version(metadata: str | Column) -> Column:
    """The version a record says it has; 1.0 for one with the plain key source_path only; else the current one."""
    text = F.coalesce(as_column(metadata), F.lit(""))
    said = F.regexp_extract(text, r'"[a-z]+_schema_version"\s*:\s*"([0-9.]+)"', 1)
    return F.when(said != "", said).when(text.rlike(r'"source_path"\s*:') & ~text.rlike(r'"[a-z]+_source_path"\s*:'), "1.0").otherwise(CURRENT)


def _looked(lookup: dict[str, str], x: Column, default: Column) -> Column:
    out = default
    for k, v in lookup.items():
        out = F.when(x == k, F.lit(v)).otherwise(out)
    return out


def media_type(file_type: Column) -> Column:
    t = F.lower(file_type)
    return _looked(MEDIA, t, F.when(t.contains("/"), t).otherwise(F.lit("application/octet-stream")))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[^.]+$", "")


def migrated(rows: DataFrame, metadata: str, prefix: str, model: str = "", dimension: int = 0) -> DataFrame:
    """rows with a column meta, the record in the current version, and from_version.

    prefix: of the application's keys, without the underscore. A record that is no JSON object counts as empty. 1.0: the title is
    the file's stem, the language en, the file type a media type. Below 2.1: public, embedded by the given model. Below
    2.2: tags that are texts have the source legacy, the tier is that of the sensitivity, personal for an unknown one.
    """
    v = parsed(metadata)
    own = lambda key, kind="string": pick(v, f"{prefix}_{key}", kind)
    was = version(metadata)
    old = was == "1.0"
    path = F.when(old, pick(v, "source_path")).otherwise(own("source_path"))
    sensitivity = F.coalesce(own("sensitivity"), F.lit("public"))
    texts = F.transform(F.coalesce(own("tags", "array<variant>"), F.array().cast("array<variant>")), _entry)
    tier = F.coalesce(own("data_tier"), _looked(TIER_OF, sensitivity, F.lit("personal")))
    fields = {
        "title": F.coalesce(pick(v, "dc_title"), F.when(old, stem(F.coalesce(path, F.lit(""))))),
        "language": F.coalesce(pick(v, "dc_language"), F.when(old, F.lit("en"))),
        "format": F.coalesce(pick(v, "dc_format"), F.when(old, media_type(F.coalesce(pick(v, "file_type"), F.lit(""))))),
        "source_path": path,
        "source_hash": F.when(old, pick(v, "content_hash")).otherwise(own("source_hash")),
        "chunk_count": F.when(old, pick(v, "chunk_count", "bigint")).otherwise(own("chunk_count", "bigint")),
        "ingestion_date": iso_instant(F.when(old, pick(v, "indexed_at")).otherwise(own("ingestion_date"))),
        "project": F.coalesce(own("project"), F.lit("")),
        "sensitivity": sensitivity,
        "embedding_model": F.coalesce(own("embedding_model"), F.lit(model)),
        "embedding_dimension": F.coalesce(own("embedding_dimension", "int"), F.lit(dimension)),
        "tags": tidy(texts),
        "data_tier": tier,
        "schema_version": F.lit(CURRENT),
    }
    return rows.withColumns({"from_version": was, "meta": F.struct(*[c.alias(k) for k, c in fields.items()])})


def _entry(x: Column) -> Column:
    """A tag of any version: a text, an object, or anything else by its text."""
    whole = F.try_variant_get(x, "$", "string")
    name = F.coalesce(F.try_variant_get(x, "$.name", "string"), whole)
    source = F.coalesce(F.try_variant_get(x, "$.source", "string"), F.lit("legacy"))
    sure = F.try_variant_get(x, "$.confidence", "double")
    at = iso_instant(F.try_variant_get(x, "$.created_at", "string"))
    by = F.try_variant_get(x, "$.created_by", "string")
    return F.struct(F.lower(F.btrim(name)).alias("name"), source.alias("source"), sure.alias("confidence"), at.alias("created_at"), by.alias("created_by")).cast(ENTRY)


def migration_counts(rows: DataFrame) -> DataFrame:
    """(from_version, records) of migrated rows that were not current."""
    return rows.where(F.col("from_version") != CURRENT).groupBy("from_version").agg(F.count("*").alias("records"))
