"""Tags of documents: collections, namespaces, suggestions, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.keys import norm_key

TIERS = ("public", "personal", "sensitive", "critical")


def tag_rows(suggestions: DataFrame, status: str = "confirmed") -> DataFrame:
    """(doc, tag): each document's tags, taken from its suggestions of one status, once each; keys normalised, nulls left out."""
    rows = suggestions.where(norm_key("status") == status).select(norm_key("doc_id").alias("doc"), norm_key("tag_name").alias("tag"))
    return rows.where("doc IS NOT NULL AND tag IS NOT NULL").distinct()


def tag_arrays(rows: DataFrame) -> DataFrame:
    """(doc, tags): the sorted tags of each document."""
    return rows.groupBy("doc").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def pattern_matches(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, tag): which distinct tags fit which distinct patterns, by an equi-join.

    Exact patterns join on the tag; a pattern with * joins on its literal beginning with all beginnings of the tags and is
    checked as a whole after it.
    """
    tags = rows.select("tag").distinct()
    p = patterns.select("pattern").where("pattern IS NOT NULL").distinct()
    exact = p.where(~F.contains("pattern", F.lit("*"))).join(tags, F.col("pattern") == F.col("tag")).select("pattern", "tag")
    globs = p.where(F.contains("pattern", F.lit("*"))).withColumn("start", F.substring_index("pattern", "*", 1))
    starts = tags.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.length("tag")), lambda i: F.substring(F.col("tag"), F.lit(1), i))))
    like = F.replace(F.regexp_replace("pattern", r"([\\%_])", r"\\$1"), F.lit("*"), F.lit("%"))
    fits = globs.join(starts, "start").where(F.like(F.col("tag"), like)).select("pattern", "tag")
    return exact.unionByName(fits)


def collection_members(rows: DataFrame, collections: DataFrame) -> DataFrame:
    """(collection, doc) for collections that name a tag to include.

    All patterns of include_all must be met, one of include_any if there are any, none of exclude. collections: (id,
    include_all, include_any, exclude). Each list is exploded and joined through the patterns' tags, so the work is that
    of the matches and not of collections times documents. A collection that includes by no tag holds every document but
    the excluded ones; these have a form of their own, see all_but and exclusions.
    """
    ids = F.col("id").alias("collection")
    need = collections.select(ids, F.size(F.array_distinct(F.coalesce("include_all", F.array()))).alias("n_all"), F.size(F.coalesce("include_any", F.array())).alias("n_any")).where("n_all + n_any > 0")

    def patterns(kind: str) -> DataFrame:
        return collections.select(ids, F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.coalesce(kind, F.array()))).alias("pattern"))

    terms = patterns("include_all").unionByName(patterns("include_any"))
    out = patterns("exclude").join(need.select("collection"), "collection", "left_semi")
    fits = pattern_matches(rows, terms.unionByName(out))
    # what a collection includes comes first; only of the documents that are in are the tags held against what it excludes
    met = terms.join(fits, "pattern").join(rows, "tag").groupBy("collection", "doc")
    count = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("pattern")))
    met = met.agg(count("include_all").alias("all"), F.count_if(F.col("kind") == "include_any").alias("any"))
    inside = met.join(need, "collection").where((F.col("all") == F.col("n_all")) & ((F.col("n_any") == 0) | (F.col("any") > 0))).select("collection", "doc")
    barred = out.join(fits, "pattern").select("collection", "tag").distinct()
    checked = inside.join(barred.select("collection").distinct(), "collection", "left_semi")
    gone = checked.join(rows, "doc").join(barred, ["collection", "tag"], "left_semi").select("collection", "doc").distinct()
    return inside.join(gone, ["collection", "doc"], "left_anti")


def all_but(collections: DataFrame) -> DataFrame:
    """The collections that include by no tag: each holds every document but those that its exclude patterns fit."""
    return collections.where((F.size(F.coalesce("include_all", F.array())) == 0) & (F.size(F.coalesce("include_any", F.array())) == 0))


def exclusions(rows: DataFrame, collections: DataFrame) -> DataFrame:
    """(collection, doc): the documents that are not in a collection which includes by no tag; the work is that of the matches."""
    terms = all_but(collections).select(F.col("id").alias("collection"), F.explode(F.array_distinct(F.coalesce("exclude", F.array()))).alias("pattern"))
    return terms.join(pattern_matches(rows, terms), "pattern").join(rows, "tag").select("collection", "doc").distinct()


def collection_sizes(rows: DataFrame, collections: DataFrame, documents: DataFrame) -> DataFrame:
    """(collection, members) for every collection. documents: (doc), once each, all that rows names among them."""
    named = collection_members(rows, collections).groupBy("collection").agg(F.count("*").alias("members"))
    out = exclusions(rows, collections).groupBy("collection").agg(F.count("*").alias("out"))
    total = documents.agg(F.count("*").alias("total"))
    rest = all_but(collections).select(F.col("id").alias("collection")).join(F.broadcast(total)).join(out, "collection", "left")  # a single row
    rest = rest.select("collection", (F.col("total") - F.coalesce("out", F.lit(0))).alias("members"))
    ids = collections.select(F.col("id").alias("collection"))
    return ids.join(named.unionByName(rest), "collection", "left").select("collection", F.coalesce("members", F.lit(0).cast("bigint")).alias("members"))


def collections_for_doc(rows: DataFrame, collections: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc, collections, first_collection) for every document that is in a collection; documents as in collection_sizes.

    Collections that include by no tag are counted as all of them less those that exclude the document. The first of these
    is the smallest id or, if that excludes the document, the smallest of the ids that follow one that excludes it and do
    not exclude it themselves.
    """
    named = collection_members(rows, collections).groupBy("doc").agg(F.count("*").alias("n"), F.min("collection").alias("first_named"))
    ids, out = all_but(collections).select(F.col("id").alias("collection")), exclusions(rows, collections)
    whole = ids.agg(F.count("*").alias("total"), F.min("collection").alias("smallest"))
    # Ids are put in order only up to the first that excludes no document.
    free = ids.join(out, "collection", "left_anti").agg(F.min("collection").alias("free"))
    near = ids.join(F.broadcast(free)).where("free IS NULL OR collection <= free").select("collection")
    following = near.select("collection", F.lead("collection").over(Window.partitionBy(F.lit(1)).orderBy("collection")).alias("next"))
    taken = out.select(F.col("collection").alias("next"), "doc", F.lit(True).alias("taken"))
    after = out.join(following, "collection").join(taken, ["next", "doc"], "left").where("taken IS NULL").groupBy("doc").agg(F.min("next").alias("after"))
    less = out.join(F.broadcast(whole)).groupBy("doc").agg(F.count("*").alias("out"), F.max(F.col("collection") == F.col("smallest")).alias("hit"))
    j = documents.join(F.broadcast(whole)).join(less, "doc", "left").join(after, "doc", "left").join(named, "doc", "left")
    first = F.when(F.coalesce("hit", F.lit(False)), F.col("after")).otherwise(F.col("smallest"))
    count = F.coalesce("n", F.lit(0)) + F.col("total") - F.coalesce("out", F.lit(0))
    return j.select("doc", count.alias("collections"), F.least("first_named", first).alias("first_collection")).where("collections > 0")


def namespaced(tag: str | Column) -> tuple[Column, Column]:
    """Namespace and value of a tag; a tag without a slash has no namespace."""
    t = F.col(tag) if isinstance(tag, str) else tag
    has = F.contains(t, F.lit("/"))
    return F.when(has, F.substring_index(t, "/", 1)), F.when(has, F.regexp_replace(t, "^[^/]*/", ""))


def tag_violations(rows: DataFrame, namespaces: DataFrame, values: DataFrame) -> DataFrame:
    """(doc, tag, problem): tags of unknown namespaces, and of closed ones with a value that is not listed."""
    ns, value = namespaced("tag")
    t = rows.withColumns({"ns": ns, "value": value}).where("ns IS NOT NULL")
    known = namespaces.select(norm_key("name").alias("ns"), "is_open").groupBy("ns").agg(F.max("is_open").alias("is_open"))
    listed = values.select(norm_key("namespace").alias("ns"), norm_key("tag_value").alias("value"), F.lit(True).alias("listed")).distinct()
    j = t.join(known, "ns", "left").join(listed, ["ns", "value"], "left")
    problem = F.when(F.col("is_open").isNull(), "unknown_namespace").when(~F.col("is_open") & F.col("listed").isNull(), "unlisted_value")
    return j.withColumn("problem", problem).where("problem IS NOT NULL").select("doc", "tag", "problem")


def tier_level(tier: str | Column) -> Column:
    """0 for public up to 3 for critical; unknown and null tiers count as personal."""
    c = norm_key(tier)
    out = F.lit(1)
    for i, name in enumerate(TIERS):
        out = F.when(c == name, F.lit(i)).otherwise(out)
    return out


def can_access(level: Column, session: bool, confirmed: bool) -> Column:
    """Public and personal always; sensitive in an open session; critical if confirmed in it too."""
    return (level <= 1) | (F.lit(session) & ((level == 2) | F.lit(confirmed)))


def step_tier(tier: str | Column, by: int) -> Column:
    """The tier by steps higher or lower; null beyond the ends."""
    level = tier_level(tier) + by
    return F.when((level >= 0) & (level < len(TIERS)), F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.least(F.greatest(level, F.lit(0)), F.lit(3)) + 1))
