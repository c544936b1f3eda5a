"""Changes of tags, collections, namespaces, suggestions: every function takes tables and gives the changed table.

Tags of a document are an array of (name, source, confidence, created_at, created_by), each name once, by name. Names and
documents compare trimmed and in lower case; null and blank names are no tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.keys import norm_key

ENTRY = "struct<name:string,source:string,confidence:double,created_at:timestamp,created_by:string>"
TAGS = f"array<{ENTRY}>"


def entry(name: Column | str, source: Column | str = "manual", confidence: Column | None = None, created_at: Column | None = None, created_by: Column | None = None) -> Column:
    """One tag; source is a literal where it is a text."""
    name = F.lit(name) if isinstance(name, str) else name
    source = F.lit(source) if isinstance(source, str) else source
    none = F.lit(None)
    parts = ((norm_key(name), "name"), (source, "source"), (none if confidence is None else confidence, "confidence"), (none if created_at is None else created_at, "created_at"), (none if created_by is None else created_by, "created_by"))
    return F.struct(*[c.alias(n) for c, n in parts]).cast(ENTRY)


def from_strings(names: str | Column, source: str = "legacy") -> Column:
    """An array of names as tags."""
    c = F.col(names) if isinstance(names, str) else names
    return tidy(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: entry(x, source)))


def tidy(tags: Column) -> Column:
    """Without nameless tags, by name, of several with one name the first."""
    fine = F.filter(F.coalesce(tags, F.array().cast(TAGS)), lambda t: t["name"].isNotNull() & (t["name"] != ""))
    names = F.array_sort(F.array_distinct(F.transform(fine, lambda t: t["name"])))
    return F.transform(names, lambda n: F.element_at(F.filter(fine, lambda t: t["name"] == n), 1))


def names_of(tags: str | Column) -> Column:
    c = F.col(tags) if isinstance(tags, str) else tags
    return F.transform(c, lambda t: t["name"])


def add(tags: str | Column, new: Column) -> Column:
    """tags with new ones; a name that is there keeps its entry."""
    c = F.col(tags) if isinstance(tags, str) else tags
    return tidy(F.concat(F.coalesce(c, F.array().cast(TAGS)), new))


def remove(tags: str | Column, names: list[str] | None = None, source: str | None = None) -> Column:
    """tags without those of the given names or of the given source."""
    c = F.col(tags) if isinstance(tags, str) else tags
    wanted = [n.strip().lower() for n in names or []]
    gone = lambda t: F.coalesce((t["name"].isin(wanted) if wanted else F.lit(False)) | (t["source"] == source if source is not None else F.lit(False)), F.lit(False))
    return tidy(F.filter(c, lambda t: ~gone(t)))


def rename(tags: str | Column, old: str, new: str) -> Column:
    """A name or, where old ends in a slash, a namespace renamed; what then stands twice is one tag."""
    c = F.col(tags) if isinstance(tags, str) else tags
    o, n = old.strip().lower(), new.strip().lower()

    def turned(t: Column) -> Column:
        name = t["name"]
        fresh = F.when(name.startswith(o), F.concat(F.lit(n), F.substring(name, F.lit(len(o) + 1), F.length(name)))).otherwise(name) if o.endswith("/") else F.when(name == o, F.lit(n)).otherwise(name)
        return t.withField("name", fresh)

    return tidy(F.transform(c, turned))


def edit(documents: DataFrame, key: str, tags: str, change: Column, where: Column | None = None) -> DataFrame:
    """documents with tags changed where the condition holds, and a column changed: whether the names differ now."""
    after = change if where is None else F.when(F.coalesce(where, F.lit(False)), change).otherwise(tidy(F.col(tags)))
    before = F.coalesce(names_of(tidy(F.col(tags))), F.array().cast("array<string>"))
    return documents.withColumn("__new", after).withColumn("changed", names_of("__new") != before).withColumn(tags, F.col("__new")).drop("__new")


# ---- collections


def create_collections(collections: DataFrame, new: DataFrame) -> DataFrame:
    """collections with new ones; an error at run time if a name is there already or comes twice. Columns as those of collections."""
    taken = collections.select(norm_key("name").alias("__n")).where("__n IS NOT NULL").distinct().withColumn("__taken", F.lit(True))
    counts = new.groupBy(norm_key("name").alias("__n")).agg(F.count("*").alias("__times"))
    checked = new.withColumn("__n", norm_key("name")).join(taken, "__n", "left").join(counts, "__n", "left")
    bad = F.col("__n").isNull() | F.coalesce("__taken", F.lit(False)) | (F.coalesce("__times", F.lit(1)) > 1)
    named = F.when(bad, F.raise_error(F.concat(F.lit("a collection cannot be named "), F.coalesce("name", F.lit("nothing"))))).otherwise(F.col("name"))
    return collections.unionByName(checked.withColumn("name", named).select(*collections.columns))


def delete_collections(collections: DataFrame, names: list[str]) -> DataFrame:
    """collections without the named ones; their children become roots."""
    gone = [n.strip().lower() for n in names]
    is_gone = F.coalesce(norm_key("name").isin(gone), F.lit(False))
    ids = collections.where(is_gone).select(norm_key("id").alias("__gone")).distinct()
    rest = collections.where(~is_gone).withColumn("__p", norm_key("parent_id")).join(ids, F.col("__p") == F.col("__gone"), "left")
    return rest.withColumn("parent_id", F.when(F.col("__gone").isNull(), F.col("parent_id"))).select(*collections.columns)


# ---- namespaces


def create_namespace(namespaces: DataFrame, values: DataFrame, name: str, is_open: bool, tags: list[str] = (), description: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables with a new namespace and its listed values; ValueError for a known name or an open one with values."""
    n = name.strip().lower()
    if not n:
        raise ValueError("a namespace needs a name")
    if is_open and tags:
        raise ValueError("an open namespace lists no values")
    if not namespaces.where(norm_key("name") == n).isEmpty():
        raise ValueError(f"namespace {n} is there already")
    spark = namespaces.sparkSession
    row = spark.createDataFrame([(n, is_open, False, False, description)], "name string, is_open boolean, is_system boolean, is_hidden boolean, description string")
    listed = spark.createDataFrame([(n, t.strip().lower()) for t in tags], "namespace string, tag_value string")
    stamped = lambda df, like: df.withColumn("created_at", F.current_timestamp()).select(*[F.col(c).cast(like.schema[c].dataType) if c in (*df.columns, "created_at") else F.lit(None).cast(like.schema[c].dataType).alias(c) for c in like.columns])
    return namespaces.unionByName(stamped(row, namespaces)), values.unionByName(stamped(listed, values))


def delete_namespace(namespaces: DataFrame, values: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a namespace; ValueError for one of the system."""
    n = name.strip().lower()
    if not namespaces.where((norm_key("name") == n) & F.col("is_system")).isEmpty():
        raise ValueError(f"{n} is a namespace of the system")
    other = lambda c: F.coalesce(norm_key(c) != n, F.lit(True))
    return namespaces.where(other("name")), values.where(other("namespace"))


def set_hidden(namespaces: DataFrame, name: str, hidden: bool) -> DataFrame:
    return namespaces.withColumn("is_hidden", F.when(norm_key("name") == name.strip().lower(), F.lit(hidden)).otherwise(F.col("is_hidden")))


def promote_pending(pending: DataFrame, values: DataFrame, names: list[str], namespace: str) -> tuple[DataFrame, DataFrame]:
    """(pending, values): pending tags (tag_name, ...) of the names moved to the listed values of a namespace, each once."""
    wanted = F.coalesce(norm_key("tag_name").isin([n.strip().lower() for n in names]), F.lit(False))
    moved = pending.where(wanted).select(F.lit(namespace.strip().lower()).alias("namespace"), norm_key("tag_name").alias("tag_value")).distinct()
    known = values.select(norm_key("namespace").alias("namespace"), norm_key("tag_value").alias("tag_value"))
    return pending.where(~wanted), values.unionByName(moved.join(known, ["namespace", "tag_value"], "left_anti"), allowMissingColumns=True)


def reject_pending(pending: DataFrame, names: list[str]) -> DataFrame:
    return pending.where(~F.coalesce(norm_key("tag_name").isin([n.strip().lower() for n in names]), F.lit(False)))


# ---- suggestions

#: How the source of a confirmed suggestion is named among a document's tags.
CONFIRMED_AS = {"keybert": "auto-keybert", "llm": "auto-llm", "ner": "auto-ner"}


def decide(suggestions: DataFrame, accept: bool, names: list[str] | None = None, least: float | None = None) -> DataFrame:
    """suggestions with those decided that are pending: of the names, and of at least the confidence, where these are given."""
    pick = norm_key("status") == "pending"
    if names is not None:
        pick = pick & norm_key("tag_name").isin([n.strip().lower() for n in names])
    if least is not None:
        pick = pick & ~F.isnan("confidence") & (F.col("confidence") >= least)
    return suggestions.withColumn("status", F.when(F.coalesce(pick, F.lit(False)), F.lit("confirmed" if accept else "rejected")).otherwise(F.col("status")))


def confirmed_tags(suggestions: DataFrame) -> DataFrame:
    """(doc, tags): the tags that confirmed suggestions give each document, with their source and confidence; of one name the surest."""
    source = F.coalesce(*[F.when(norm_key("source") == k, F.lit(v)) for k, v in CONFIRMED_AS.items()], norm_key("source"))
    rows = suggestions.where(norm_key("status") == "confirmed").select(norm_key("doc_id").alias("doc"), norm_key("tag_name").alias("name"), source.alias("source"), F.nanvl("confidence", F.lit(None).cast("double")).alias("confidence"), "source_model")
    rows = rows.where("doc IS NOT NULL AND name IS NOT NULL")
    best = rows.groupBy("doc", "name").agg(F.max(F.struct("confidence", "source", "source_model")).alias("b"))
    return best.groupBy("doc").agg(tidy(F.collect_list(entry(F.col("name"), F.col("b.source"), F.col("b.confidence"), None, F.col("b.source_model")))).alias("tags"))


def suggestion_name(source: Column, text: Column, entity_type: Column | None = None) -> Column:
    """The tag that a finding suggests: its words in lower case joined by hyphens, under its type for named entities."""
    slug = F.btrim(F.regexp_replace(F.lower(F.btrim(text)), "[^\\p{L}\\p{N}]+", "-"), F.lit("-"))
    typed = F.concat(F.coalesce(F.lower(entity_type) if entity_type is not None else F.lit(None), F.lit("entity")), F.lit("/"), slug)
    return F.when(source == "ner", typed).otherwise(slug)
