"""Entities by pattern with type and confidence, their counters and relations kept in tables, and searches over them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Names by type, and how sure a match of each type is.
NAMES = {
    "technology": (
        0.85,
        "Python JavaScript TypeScript Rust Go Java C++ Ruby PHP React Angular Vue Django Flask FastAPI Express Rails PostgreSQL MySQL MongoDB Redis Elasticsearch SQLite Docker Kubernetes AWS Azure GCP Terraform "
        "GraphQL REST gRPC WebSocket HTTP HTTPS JWT OAuth SAML SSO LDAP Kerberos Git GitHub GitLab Bitbucket Linux macOS Windows Ubuntu Debian TensorFlow PyTorch Keras scikit-learn spaCy LLM GPT BERT Transformer RAG NLP".split(),
    ),
    "concept": (0.8, "machine learning|deep learning|neural network|authentication|authorisation|encryption|microservice|monolith|serverless|CI/CD|DevOps|SRE|API|SDK|CLI|GUI".split("|")),
    "organisation": (0.9, "Google|Microsoft|Amazon|Apple|Meta|Facebook|OpenAI|Anthropic|DeepMind|Hugging Face|Netflix|Spotify|Uber|Airbnb|Stripe".split("|")),
}
ORDER = tuple(NAMES)
#: So many related entities and documents an entity's view shows.
MOST_RELATED, MOST_DOCUMENTS = 20, 10


def _escaped(name: str) -> str:
    return "".join(f"\\{c}" if c in "+./-" else c for c in name)


def pattern(kind: str, names: dict | None = None) -> str:
    listed = sorted((names or NAMES)[kind][1], key=lambda n: (-len(n), n))
    plain, signed = ([_escaped(n) for n in listed if n[-1].isalnum() == x] for x in (True, False))
    return r"(?i)\b(?:" + "|".join([*signed, r"(?:" + "|".join(plain) + r")\b"]) + ")"


def extract(texts: DataFrame, key: str, text: str, least: float = 0.7, names: dict | None = None, keep: list[str] = ()) -> DataFrame:
    """(key, *keep, name, type, confidence, position): the entities a text names, each name once, whatever its case.

    A name of several types has the first of them in the order technology, concept, organisation; position is that of its first match
    among the text's matches of the type. Types under the least confidence and null texts give nothing. names may be
    another table of (confidence, names) by type.
    """
    table = names or NAMES
    found = None
    for i, (kind, (sure, _)) in enumerate(table.items()):
        if sure < least:
            continue
        hits = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern(kind, table)), F.lit(0))
        one = _typed(F.array_distinct(F.transform(hits, lambda h: F.lower(h))), i, kind, sure)
        found = one if found is None else F.concat(found, one)
    rows = texts.select(F.col(key), *keep, F.explode(found).alias("e"))
    best = rows.groupBy(key, *keep, "e.name").agg(F.min_by("e", "e.o").alias("e"))
    return best.select(key, *keep, "e.name", "e.type", "e.confidence", "e.position")


def _typed(names: Column, order: int, kind: str, sure: float) -> Column:
    return F.transform(names, lambda n, j: F.struct(n.alias("name"), F.lit(order).alias("o"), F.lit(kind).alias("type"), F.lit(sure).alias("confidence"), j.alias("position")))


def of_types(entities: DataFrame, types: list[str]) -> DataFrame:
    return entities.where(F.col("type").isin(types))


def counters(adds: DataFrame) -> DataFrame:
    """(name, type, doc_count, chunk_count) of adds (name, type, at): both counters go up with every add, so doc_count counts adds too; the type is the first seen."""
    return adds.groupBy("name").agg(F.min_by("type", F.struct("at", "type")).alias("type"), F.count("*").alias("doc_count"), F.count("*").alias("chunk_count"))


def merged_counters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counters of both; the type of the old ones stays."""
    n = new.select("name", F.col("type").alias("__t"), F.col("doc_count").alias("__d"), F.col("chunk_count").alias("__c"))
    j = old.join(n, "name", "full_outer")
    plus = lambda a, b: (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).cast("bigint")
    return j.select("name", F.coalesce("type", "__t").alias("type"), plus("doc_count", "__d").alias("doc_count"), plus("chunk_count", "__c").alias("chunk_count"))


def relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, target, relation, weight): of relations that come again the largest weight holds."""
    return old.unionByName(new).groupBy("source", "target", "relation").agg(F.max("weight").alias("weight"))


def search(counted: DataFrame, query: str, most: int) -> DataFrame:
    """Entities whose name holds the query, whatever the case, the most added first; % and _ in a query stand for anything, as in LIKE."""
    hit = F.lower(F.col("name")).like(f"%{query.lower()}%")
    return counted.where(hit).orderBy(F.desc("doc_count"), "name").limit(most)


def graph_statistics(counted: DataFrame, edges: DataFrame, mentions: DataFrame, document: str) -> DataFrame:
    """(kind, name, n): the counts of entities, edges, mentions and documents, and of entities by type."""
    one = lambda df, name: df.select(F.lit("total").alias("kind"), F.lit(name).alias("name"), "n")
    count = lambda df: df.agg(F.count("*").alias("n"))
    whole = one(count(counted), "entities").unionByName(one(count(edges), "edges")).unionByName(one(count(mentions), "mentions"))
    whole = whole.unionByName(one(mentions.agg(F.count_distinct(document).alias("n")), "documents"))
    return whole.unionByName(counted.groupBy(F.lit("type").alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias("n")))


def explore(related: DataFrame, mentions: DataFrame, document: str, name: str) -> DataFrame:
    """(kind, name, score): an entity's MOST_RELATED related ones (entity, score) by score and MOST_DOCUMENTS documents by number of mentions."""
    near = related.orderBy(F.desc("score"), "entity").limit(MOST_RELATED).select(F.lit("related").alias("kind"), F.col("entity").alias("name"), F.col("score").cast("double").alias("score"))
    docs = mentions.where(F.col("name") == name).groupBy(F.col(document).cast("string").alias("name")).agg(F.count("*").cast("double").alias("score"))
    return near.unionByName(docs.orderBy(F.desc("score"), "name").limit(MOST_DOCUMENTS).select(F.lit("document").alias("kind"), "name", "score"))


def keyword_candidates(text: str | Column) -> Column:
    """The distinct words and pairs of words of a text, of over two letters each."""
    from docweave.functions.text import tokens

    w = F.filter(tokens(text), lambda x: F.length(x) > 2)
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(w, pairs)


def keywords(texts: DataFrame, key: str, text: str, most: int, diversity: float = 0.5, pool: int = 30) -> DataFrame:
    """(key, keyword, score, rank): words and pairs by maximal marginal relevance: term frequency times inverse document frequency, less what earlier
    keywords share with it.

    Of each text the pool best by relevance are candidates, the best of these is taken most times over; two candidates are alike by
    the share of their words in common. Statistics are over all texts; null texts have no keyword.
    """
    rows = texts.select(F.col(key).alias("k"), F.explode(keyword_candidates(text)).alias("w")).groupBy("k", "w").agg(F.count("*").alias("tf"))
    total = texts.agg(F.count("*").alias("n"))
    df = rows.groupBy("w").agg(F.count("*").alias("df"))
    scored = rows.join(df, "w").join(F.broadcast(total)).select("k", "w", (F.col("tf") * F.log((F.col("n") + 1) / F.col("df"))).alias("s"))  # one row
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("s"), "w"))
    best = scored.withColumn("r", place).where(F.col("r") <= pool).groupBy("k").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "w"))).alias("c"))  # pool of them

    @F.pandas_udf("array<struct<keyword:string,score:double,rank:int>>")
    def pick(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([_marginal([(-x["s"], x["w"]) for x in c], most, diversity) for c in s], dtype="object")

    return best.select(F.col("k").alias(key), F.explode(pick("c")).alias("x")).select(key, "x.*")


def _marginal(candidates: list[tuple[float, str]], most: int, diversity: float) -> list[dict]:
    top = max((s for s, _ in candidates), default=1.0) or 1.0
    left = [(s / top, w, set(w.split())) for s, w in candidates]
    out: list[tuple[str, float, set]] = []
    while left and len(out) < most:
        gain = lambda x: (1 - diversity) * x[0] - diversity * max((len(x[2] & y[2]) / len(x[2] | y[2]) for y in out), default=0.0)
        best = max(left, key=lambda x: (gain(x), x[0], x[1]))
        left.remove(best)
        out.append((best[1], best[0], best[2]))
    return [{"keyword": w, "score": round(s, 6), "rank": i} for i, (w, s, _) in enumerate(out, 1)]
