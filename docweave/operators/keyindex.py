"""A keyword index that is kept: postings in a folder, added to, replaced by document, deleted from and searched.

Postings (term, document, chunk, tf, len, positions) lie in buckets by the term's hash, sorted by term, so that a query reads
the row groups of its terms. Each change has a number; a document's live rows are those of its latest change, so that replacing
or deleting one writes only what is new. compact() rewrites the live rows into one change.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.stem import fold, index_tokens, index_words
from docweave.operators.querylang import Both, Not, Phrase, Term, parse_or_words
from docweave.operators.search import B, K1, top

BUCKETS = 32
_POSTINGS = "term string, document string, chunk string, tf int, len int, positions array<int>, change int, bucket int"
_STATE = "document string, live boolean, chunks bigint, change int"
_CHUNKS = "document string, chunk string, len int, change int"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - F.lit(by))


class KeywordIndex:
    """chunks (document, chunk, text) under a folder.

    Documents and chunks with a null key are left out; null and empty texts are chunks of no word; a chunk that comes twice in
    one change counts once, with its longest text. Extra columns are ignored. An empty index finds nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, stemmed: bool = True):
        self.spark, self.folder, self.stemmed = spark, folder, stemmed
        self._statistics: tuple[int, int, float] | None = None

    def _read(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def _next(self) -> int:
        return (self._read("state", _STATE).agg(F.max("change")).first()[0] or 0) + 1

    def add(self, chunks: DataFrame, document: str = "document", chunk: str = "chunk", text: str = "text") -> int:
        """Adds the documents of chunks, each in place of what the index has of it; the number of the change."""
        number = self._next()
        rows = chunks.select(F.col(document).cast("string").alias("document"), F.col(chunk).cast("string").alias("chunk"), F.col(text).alias("text"))
        rows = rows.where("document IS NOT NULL AND chunk IS NOT NULL").groupBy("document", "chunk").agg(F.max_by("text", F.struct(F.coalesce(F.length("text"), F.lit(0)), "text")).alias("text"))
        words = rows.select("document", "chunk", index_tokens("text", self.stemmed).alias("w")).withColumn("len", F.size("w"))
        each = words.select("document", "chunk", "len", F.posexplode("w").alias("at", "term"))
        posted = each.groupBy("term", "document", "chunk", "len").agg(F.array_sort(F.collect_list("at")).alias("positions"))  # one chunk's places of one word
        posted = posted.select("term", "document", "chunk", F.size("positions").alias("tf"), "len", "positions", F.lit(number).alias("change"), _bucket(F.col("term")).alias("bucket"))
        posted.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/postings")
        words.select("document", "chunk", "len", F.lit(number).alias("change")).write.mode("append").parquet(f"{self.folder}/chunks")
        # the state comes last: rows of a change that broke off belong to no live document
        rows.groupBy("document").agg(F.lit(True).alias("live"), F.count("*").alias("chunks"), F.lit(number).alias("change")).write.mode("append").parquet(f"{self.folder}/state")
        self._statistics = None
        return number

    def delete(self, documents: DataFrame, document: str = "document") -> int:
        """Takes documents out; how many of them were there."""
        gone = documents.select(F.col(document).cast("string").alias("document")).distinct()
        held = self.documents().join(gone, "document", "left_semi")
        number, n = self._next(), held.count()
        if n:
            held.select("document", F.lit(False).alias("live"), F.lit(0).cast("bigint").alias("chunks"), F.lit(number).alias("change")).write.mode("append").parquet(f"{self.folder}/state")
            self._statistics = None
        return n

    def documents(self) -> DataFrame:
        """(document, change, chunks) of every live document."""
        last = self._read("state", _STATE).groupBy("document").agg(F.max_by(F.struct("live", "chunks"), "change").alias("s"), F.max("change").alias("change"))
        return last.where("s.live").select("document", "change", "s.chunks")

    def exists(self, documents: DataFrame, document: str = "document") -> DataFrame:
        """(document, there) of each of the documents asked for."""
        asked = documents.select(F.col(document).cast("string").alias("document")).where("document IS NOT NULL").distinct()
        return asked.join(self.documents().select("document", F.lit(True).alias("there")), "document", "left").select("document", F.coalesce("there", F.lit(False)).alias("there"))

    def statistics(self) -> tuple[int, int, float]:
        """(documents, chunks, mean length); read once until the index changes."""
        if self._statistics is None:
            live = self._read("chunks", _CHUNKS).join(self.documents().select("document", "change"), ["document", "change"], "left_semi")
            r = live.agg(F.count_distinct("document").alias("d"), F.count("*").alias("n"), F.avg("len").alias("l")).first()
            self._statistics = (r["d"], r["n"], r["l"] or 0.0)
        return self._statistics

    def postings(self, terms: list[str], prefixes: list[str] = ()) -> DataFrame:
        """The live postings of terms; a prefix reads the range of terms that begin with it, in every bucket."""
        rows = self._read("postings", _POSTINGS)
        hit = F.lit(False)
        if terms:
            numbers = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"))).distinct().collect()]  # the query's terms
            hit = F.col("bucket").isin(numbers) & F.col("term").isin(list(terms))
        for p in prefixes:
            hit = hit | ((F.col("term") >= p) & (F.col("term") < p + "\U0010ffff"))
        return rows.where(hit).join(self.documents().select("document", "change"), ["document", "change"], "left_semi")

    def search(self, query: str, k: int = 10, documents: list[str] | None = None) -> DataFrame:
        """(document, chunk, score, rank): the k best chunks for a boolean query, by BM25 over its positive items.

        A phrase is one item, with its number of occurrences. N, document frequency and mean length are over the chunks of the
        whole index. documents restricts the results; None and an empty list restrict nothing. A query that cannot be read is
        its words joined by AND; a blank one finds nothing. Ties go to the smaller document and chunk.
        """
        empty = self.spark.createDataFrame([], "document string, chunk string, score double, rank int")
        if not index_words(query.replace("*", "")):
            return empty
        _, total, mean = self.statistics()
        scored = self.matches(parse_or_words(query))
        if scored is None or not total:
            return empty
        counted, positive = scored
        frequencies = counted.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in positive]).first()
        score = F.lit(0.0)
        for i in positive:
            n = frequencies[f"n{i}"]
            idf = F.log(F.lit((total - n + 0.5) / (n + 0.5)))
            f = F.col(f"f{i}")
            score = score + F.greatest(idf, F.lit(1e-6)) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.lit(mean or 1.0)))
        hits = counted.where("__match")
        if documents:
            hits = hits.where(F.col("document").isin(list(documents)))
        ranked = top(hits.select(F.struct("document", "chunk").alias("id"), F.round(score, 6).alias("score")), k)
        return ranked.select("id.document", "id.chunk", "score", "rank")

    def matches(self, tree: object) -> tuple[DataFrame, list[int]] | None:
        """(document, chunk, len, f0, f1, ..., __match) of chunks with any item of the query, and the numbers of its positive items."""
        items: list[tuple[list[str], bool]] = []
        positive: list[int] = []

        def leaf(words: list[str], prefix: bool, sign: bool) -> Column:
            items.append((words, prefix))
            if sign:
                positive.append(len(items) - 1)
            return F.col(f"f{len(items) - 1}") > 0

        def walk(x: object, sign: bool) -> Column | None:
            if isinstance(x, (Term, Phrase)):
                words = [w for part in ([x.word] if isinstance(x, Term) else x.words) for w in ([fold(part)] if isinstance(x, Term) and x.prefix else index_words(part, self.stemmed))]
                return leaf(words, isinstance(x, Term) and x.prefix, sign) if words else None
            if isinstance(x, Not):
                inner = walk(x.of, not sign)
                return None if inner is None else ~inner
            sides = [c for c in (walk(x.left, sign), walk(x.right, sign)) if c is not None]
            return reduce((lambda a, b: a & b) if isinstance(x, Both) else (lambda a, b: a | b), sides) if sides else None

        match = walk(tree, True)
        if match is None or not positive:
            return None
        terms = sorted({w for words, prefix in items if not prefix for w in words})
        rows = self.postings(terms, sorted({words[0] for words, prefix in items if prefix}))
        columns = []
        for i, (words, prefix) in enumerate(items):
            if prefix:
                columns.append(F.coalesce(F.sum(F.when(F.col("term").startswith(words[0]), F.col("tf"))), F.lit(0)).alias(f"f{i}"))
            elif len(words) == 1:
                columns.append(F.coalesce(F.max(F.when(F.col("term") == words[0], F.col("tf"))), F.lit(0)).alias(f"f{i}"))
            else:
                places = [F.coalesce(F.max(F.when(F.col("term") == w, F.col("positions"))), F.array().cast("array<int>")) for w in words]
                shifted = [_moved(p, j) for j, p in enumerate(places)]
                columns.append(F.size(reduce(F.array_intersect, shifted)).alias(f"f{i}"))
        counted = rows.groupBy("document", "chunk").agg(F.max("len").alias("len"), *columns)
        return counted.withColumn("__match", match), positive

    def compact(self) -> None:
        """The live rows as one change in a new folder beside this one, which the index then reads."""
        live = self.documents().select("document", "change")
        fresh = f"{self.folder}-{self._next()}"
        keep = lambda name, schema: self._read(name, schema).join(live, ["document", "change"], "left_semi").withColumn("change", F.lit(1))
        keep("postings", _POSTINGS).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{fresh}/postings")
        keep("chunks", _CHUNKS).write.parquet(f"{fresh}/chunks")
        keep("state", _STATE).write.parquet(f"{fresh}/state")
        self.folder, self._statistics = fresh, None
