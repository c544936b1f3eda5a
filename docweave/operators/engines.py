"""What a caller plugs in: embedders, rerankers, entity extractors, language models, readers; and models by name and task.

An engine is an object that can be pickled; each worker process makes it once from its factory, so a model is loaded
once a worker and no registration has to reach the executors.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any, Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@runtime_checkable
class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@runtime_checkable
class VisionEmbedder(Protocol):
    dimension: int

    def embed_images(self, images: list[bytes]) -> list[list[float]]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@runtime_checkable
class Reranker(Protocol):
    def scores(self, query: str, texts: list[str]) -> list[float]: ...


@runtime_checkable
class EntityExtractor(Protocol):
    def extract(self, text: str) -> list[tuple[str, str, float]]:
        """(name, type, confidence) of every entity."""


@runtime_checkable
class Chunker(Protocol):
    def chunk(self, text: str) -> list[tuple[int, int]]:
        """(start, stop) of every chunk."""


@runtime_checkable
class Extractor(Protocol):
    def extract(self, data: bytes) -> str: ...


@runtime_checkable
class PageReader(Protocol):
    """A reader of paged files, of text or by recognition: one text and confidence a page."""

    def pages(self, data: bytes) -> Iterator[tuple[int, str, float]]: ...


@runtime_checkable
class LanguageModel(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


@runtime_checkable
class VectorStore(Protocol):
    """The contract of a store; operators.documents.DocumentStore keeps it."""

    def add(self, documents: DataFrame, chunks: DataFrame) -> None: ...

    def delete(self, documents: DataFrame) -> dict[str, int]: ...

    def held_chunks(self) -> DataFrame: ...

    def statistics(self) -> DataFrame: ...


@lru_cache(maxsize=8)
def _made(factory: Callable[[], Any]) -> Any:
    return factory()


class HashedEmbedder:
    """Vectors without a model: signed counts of hashed words and pairs of words, of length 1. Equal texts have equal vectors; a text without a word is all zero."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        import xxhash

        out = np.zeros((len(texts), self.dimension))
        for row, t in zip(out, texts):
            words = re.findall(r"[^\W_]+", (t or "").lower())
            for w in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
                h = xxhash.xxh3_64_intdigest(w)
                row[h % self.dimension] += 1.0 if h >> 63 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size > 0, size, 1.0)).tolist()


def embedded(text: str | Column, factory: Callable[[], Embedder]) -> Column:
    """The vectors of a text column, a batch at a time; null for null."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        engine = _made(factory)
        for s in batches:
            there = s.notna()
            out = pd.Series([None] * len(s), dtype="object", index=s.index)
            if there.any():
                vectors = engine.embed(s[there].tolist())
                out[there] = pd.Series([[float(x) for x in v] for v in vectors], index=s.index[there], dtype="object")
            yield out

    return run(F.col(text) if isinstance(text, str) else text)


def reranked(results: DataFrame, query: str, text: str, factory: Callable[[], Reranker] | None, k: int, least: float | None = None, rank: str = "rank", key: str = "id") -> DataFrame:
    """results with rerank_score, original_rank and final_rank: ranked anew by an engine, then the least score, then the k best.

    Final ranks are given before the least score is asked for. Without an engine the order stays and scores are null. Null
    texts score as empty ones; ties keep their order.
    """
    rows = results.withColumn("original_rank", F.col(rank))
    if factory is None:
        return rows.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("final_rank", F.col(rank)).where(F.col("final_rank") <= k)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        engine = _made(factory)
        for s in batches:
            yield pd.Series([float(x) for x in engine.scores(query, s.fillna("").tolist())])

    final = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("rerank_score"), "original_rank", key))  # the results of one query
    out = rows.withColumn("rerank_score", score(F.col(text))).withColumn("final_rank", final)
    return (out if least is None else out.where(F.col("rerank_score") >= least)).where(F.col("final_rank") <= k)


class OverlapReranker:
    """Scores by the share of the query's distinct words that a text has."""

    def scores(self, query: str, texts: list[str]) -> list[float]:
        from docweave.functions.stem import index_words

        q = set(index_words(query))
        return [round(len(q & set(index_words(t))) / len(q), 6) if q else 0.0 for t in texts]


def read_pages(files: DataFrame, factory: Callable[[], PageReader], least: float = 0.0, most: int | None = None) -> DataFrame:
    """(path, page, text, confidence, error) of binary files (path, content): a row a page, or one with the error.

    Pages below the least confidence are left out, and those after the first most. Files are read one at a time, pages as they come.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _made(factory)
        for b in batches:
            for path, data in zip(b["path"], b["content"]):
                rows, error = [], None
                try:
                    for number, text, sure in reader.pages(bytes(data)):
                        if most is not None and len(rows) >= most:
                            break
                        if sure >= least:
                            rows.append((path, number, text, float(sure), None))
                except Exception as e:  # noqa: BLE001 - a file that cannot be read is a row
                    error = f"{type(e).__name__}: {e}"
                if error or not rows:
                    rows.append((path, None, None, None, error or "no page"))
                yield pd.DataFrame(rows, columns=["path", "page", "text", "confidence", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, confidence double, error string")


def similar_images(images: DataFrame, key: str, vector: str, probe: list[float], k: int, document: str | None = None, own: str | None = None) -> DataFrame:
    """(id, score, rank): the k images nearest to a vector by cosine, 1 less the distance; of one document if it is given; own is left out, the image that asks."""
    from docweave.operators.search import knn_cosine

    rows = images if document is None else images.where(F.col("document_id") == document)
    rows = rows if own is None else rows.where(F.col(key) != own)
    return knn_cosine(rows, key, vector, probe, k, unclamped=True)


# ---- models

CAPACITY = ((8, "minimal"), (16, "standard"), (32, "high"))


def hardware_tier(memory_gb: Column) -> Column:
    """minimal under 8 GB, standard under 16, high under 32, else extreme; null for null."""
    out = F.lit("extreme")
    for limit, name in reversed(CAPACITY):
        out = F.when(memory_gb < limit, name).otherwise(out)
    return F.when(memory_gb.isNotNull(), out)


# What a model's name says of its type.
TYPES = {"embedding": "embed|minilm|bge|e5-|gte-|nomic", "vision": "vision|llava|clip|colpali|-vl", "reranker": "rerank|cross-encoder", "code": "code|coder|starcoder", "chat": ""}
FAMILIES = "llama mistral mixtral qwen gemma phi deepseek falcon nomic bge minilm e5 gte clip llava starcoder".split()


def inferred(name: str | Column) -> Column:
    """(type, family, parameters_b, context, memory_gb) of a model from its name: parameters by "7b", context by "32k", memory as 0.6 GB a
    billion and 1 more."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    kind, family = F.lit("chat"), F.lit(None).cast("string")
    for k, p in reversed([(k, p) for k, p in TYPES.items() if p]):
        kind = F.when(n.rlike(p), k).otherwise(kind)
    for f in reversed(FAMILIES):
        family = F.when(n.contains(f), f).otherwise(family)
    size = F.nullif(F.regexp_extract(n, r"(?:^|[^a-z0-9.])(\d+(?:\.\d+)?)b(?:[^a-z]|$)", 1), F.lit("")).cast("double")
    context = F.nullif(F.regexp_extract(n, r"(\d+)k(?:[^a-z0-9]|$)", 1), F.lit("")).cast("int") * 1024
    return F.struct(kind.alias("type"), family.alias("family"), size.alias("parameters_b"), context.alias("context"), F.round(size * 0.6 + 1, 1).alias("memory_gb"))


def merged_metadata(sources: list[DataFrame], key: str = "model") -> DataFrame:
    """One row a model from tables in order of trust, the last the most: of each field its last value that is not null."""
    fields = [c for c in dict.fromkeys(c for s in sources for c in s.columns) if c != key]
    whole = None
    for i, s in enumerate(sources):
        one = s.select(F.col(key), F.lit(i).alias("__order"), *[(F.col(f) if f in s.columns else F.lit(None)).alias(f) for f in fields])
        whole = one if whole is None else whole.unionByName(one)
    pick = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("__order"))).alias(f) for f in fields]
    return whole.where(F.col(key).isNotNull()).groupBy(key).agg(*pick)


def route(task: str, available: set[str], routes: dict[str, str], default: str | None = None, fallback: str | None = None, override: str | None = None) -> str:
    """The model for a task: an override (LookupError if it is not there), the task's, the default, the fallback, the first that is there."""
    if override is not None:
        if override not in available:
            raise LookupError(f"model {override} is not there")
        return override
    for name in (routes.get(task), default, fallback):
        if name in available:
            return name
    raise LookupError(f"no model for {task}")


def recommended(models: DataFrame, use: str, memory_gb: float, k: int) -> DataFrame:
    """(model, score, fits, rank) of models (model, capabilities array<string>, memory_gb, quality): 0.5 for the use, 0.3 for memory, 0.2 x quality;
    models that need more memory than there is score 0 for it and come after all that fit."""
    fits = F.coalesce(F.col("memory_gb") <= memory_gb, F.lit(True))
    score = F.when(F.coalesce(F.array_contains("capabilities", use), F.lit(False)), 0.5).otherwise(0.0) + F.when(fits, 0.3).otherwise(0.0) + 0.2 * F.coalesce("quality", F.lit(0.0))
    rows = models.select("model", F.round(score, 6).alias("score"), fits.alias("fits"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("fits"), F.desc("score"), "model"))  # a table of models
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


class Templates:
    """Prompt templates by category and name; an override is looked up in files first, then inline, then the registered one."""

    def __init__(self) -> None:
        self._known: dict[tuple[str, str], str] = {}

    def register(self, category: str, name: str, template: str) -> None:
        self._known[(category, name)] = template

    def names(self) -> list[str]:
        return sorted(f"{c}/{n}" for c, n in self._known)

    def get(self, category: str, name: str, inline: str | None = None, files: dict[str, str] | None = None) -> str:
        """KeyError for one that nothing has."""
        return (files or {}).get(f"{category}/{name}") or inline or self._known[(category, name)]

