"""The pN_ queries of the problems for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.llm import history, mixing, scans, splitting, tokenize, truncation, unify, vectors
from docweave.operators import search
from docweave.session import Scratch, table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows whose texts differ in their characters and read the same."""
    pairs = unify.look_alike_pairs(table(spark, sf_dir, "normalisation_results"), "result_id", "text")
    return pairs.select(F.col("key_a").alias("result_id_a"), F.col("key_b").alias("result_id_b"))


def p6_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its consistent form."""
    rows = table(spark, sf_dir, "normalisation_results").dropDuplicates(["result_id"])
    return rows.select("result_id", unify.unify_column("text").alias("text"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms that several spellings share: how many rows and spellings have them."""
    return unify.look_alike_classes(table(spark, sf_dir, "normalisation_results"), "result_id", "text")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k; [] for empty and null texts."""
    return tokenize.encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the shares that mixture_targets asks for, at the largest total that allows all shares."""
    return mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets")).rows()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every listed source."""
    return mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets")).shares()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every chunk that exceeds the chunk size of its strategy."""
    rows = table(spark, sf_dir, "vector_metadata").select("vector_id", "content", "metadata")
    return splitting.split_rows(splitting.with_limits(rows, table(spark, sf_dir, "chunking_config")), "vector_id", "content")


def p4_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each oversized chunk come to: the characters of their own parts, and whether every piece is within its limit."""
    limits = splitting.with_limits(table(spark, sf_dir, "vector_metadata").select("vector_id", "metadata"), table(spark, sf_dir, "chunking_config"))
    own = F.substring(F.col("content"), F.col("core") - F.col("start") + 1, F.col("stop") - F.col("core"))
    each = p4_pieces(spark, sf_dir).groupBy("vector_id").agg(F.sum(F.length(own)).cast("bigint").alias("characters"), F.max(F.floor(F.length("content") / 4)).alias("largest"))
    size = limits.groupBy("vector_id").agg(F.max("chunk_size").alias("chunk_size"))
    return each.join(size, "vector_id").select("vector_id", "characters", (F.col("largest") <= F.col("chunk_size")).alias("within"))


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each listed source that has documents keeps its repetitions, and its share up to the tokens of two documents."""
    m = mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets"))
    most = m.sized.groupBy("source").agg(F.max("tokens").alias("most"))
    s = m.shares().join(most, "source")
    share = sum(m.targets[x][0] for x in m.held) or 1.0
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))  # over the targets
    off = F.abs(F.col("used_tokens") - F.col("target_share") / F.lit(share) * total)
    return s.withColumn("off", off).select("source", (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_kept"), (F.col("off") <= 2 * F.col("most")).alias("share_kept"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that had to be split: those with more than one piece."""
    return p4_pieces(spark, sf_dir).where("piece = 1").select("vector_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks, each among the other's ten nearest, with a cosine of at least 0.9."""
    index = vectors.MultiprobeIndex(table(spark, sf_dir, "chunk_embeddings"), "chunk_id", "embedding")
    pairs = vectors.mutual(index.nearest(0.9, every_member=False))
    return pairs.select(F.col("key_a").alias("chunk_id_a"), F.col("key_b").alias("chunk_id_b"))


def p3_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every chunk's ten nearest those of a cosine of at least 0.9, by hashing."""
    index = vectors.MultiprobeIndex(table(spark, sf_dir, "chunk_embeddings"), "chunk_id", "embedding")
    return index.nearest(0.9).select(F.col("key").alias("chunk_id"), "neighbour", F.round("cosine", 6).alias("score"), "rank")


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the exact neighbours (p3_ten) of a cosine of at least 0.9 hashing finds: (queries, neighbours, found, recall)."""
    names = table(spark, sf_dir, "vector_metadata").select("vector_id", "chunk_id").distinct()
    true = p3_ten(spark, sf_dir).where("score >= 0.9").select(F.col("query_id").alias("vector_id"), "id")
    by_name = p3_near(spark, sf_dir).join(names, "chunk_id").select("vector_id", "neighbour")
    found = by_name.join(names.select(F.col("chunk_id").alias("neighbour"), F.col("vector_id").alias("id")), "neighbour").select("vector_id", "id", F.lit(1).alias("hit"))
    both = true.join(found, ["vector_id", "id"], "left")
    return both.agg(F.count_distinct("vector_id").alias("queries"), F.count("*").alias("neighbours"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each ingest batch that repeat an accepted row, exactly by hash or nearly by content."""
    records = history.same_hash(table(spark, sf_dir, "document_records"), "record_id", "batch_no", "document_id", "content_hash")
    chunks = history.near_repeats(table(spark, sf_dir, "vector_metadata").select("vector_id", "batch_no", "content"), "vector_id", "batch_no", "content")
    one = records.select(F.lit("document_records").alias("table_name"), F.col("kept").alias("kept_id"), F.col("repeated").alias("dup_id"))
    return one.unionByName(chunks.select(F.lit("vector_metadata").alias("table_name"), F.col("kept").alias("kept_id"), F.col("repeated").alias("dup_id")))


def p2_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near repeats of vector_metadata once more, in four adds of ten batches, each by a new object on the folder the last one left."""
    rows = table(spark, sf_dir, "vector_metadata").select("vector_id", "batch_no", "content")
    folder = Scratch(spark, "accepted").path("index")
    out = None
    for number in range(1, 5):
        batch = F.coalesce("batch_no", F.lit(40))
        part = rows.where((F.ceil(batch / 10) == number) if number < 4 else (batch > 30))
        found = history.Accepted(spark, folder).add(part, "vector_id", "batch_no", "content", number=number, last=number == 4)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("kept").alias("kept_id"), F.col("repeated").alias("dup_id"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of noise in every scanned text."""
    return scans.ScanNoise(table(spark, sf_dir, "normalisation_results"), "result_id", "text").found()


def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without page furniture, with whole words and paragraphs."""
    return scans.ScanNoise(table(spark, sf_dir, "normalisation_results"), "result_id", "text").repaired()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncation.Truncation(table(spark, sf_dir, "documents")).found()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.Truncation(table(spark, sf_dir, "documents")).rates()


def p3_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten nearest, exactly: queries are the chunks whose vector_id is divisible by 20, against all chunks, in blocks."""
    names = table(spark, sf_dir, "vector_metadata").select("vector_id", "chunk_id").distinct()
    rows = table(spark, sf_dir, "chunk_embeddings").where(vectors.usable("embedding", 64)).groupBy("chunk_id").agg(F.min("embedding").alias("embedding"))
    named = rows.join(names, "chunk_id").select("vector_id", "embedding")
    return search.knn_batch(named.where("vector_id % 20 = 0"), named, "vector_id", "embedding", 10, 64).select("query_id", "id", "score", "rank")


QUERIES = {"p3_ten": p3_ten, "p3_near": p3_near, "p3_recall": p3_recall, "p10_found": p10_found, "p10_rates": p10_rates, "p7_found": p7_found, "p7_repaired": p7_repaired, "p2_found": p2_found, "p2_batches": p2_batches, "p3_found": p3_found, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_whole": p4_whole, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_kept": p9_kept, "p8_ids": p8_ids, "p6_found": p6_found, "p6_unified": p6_unified, "p6_classes": p6_classes}
