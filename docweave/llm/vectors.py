"""Most similar vectors for every vector by multiprobe p-stable hashing.

Vectors are brought to length 1, so that nearness by cosine is nearness by Euclidean distance, and hashed by
tables of floor((a.x + b) / width) with normal a. Every vector is stored under its own bucket of each table and
visits, besides it, the buckets reached by moving single hashes by one, in the order of estimated success: the
sum of the squared distances of x to the boundaries crossed. Candidates of all tables are merged and ranked by exact
cosine. Equal vectors are one class with one entry in the tables; every member of a class has its neighbours.

The tables are met in rounds, a table or a part of its visits at a time, and what a round shuffled is freed before the
next, so that the disk holds the vectors once and one round, however many tables there are.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.session import Scratch, freeing

WIDTH = 3.0
PROBES = 20
#: The share of the pairs at the asked cosine that tables and probes together are to meet, as expected; it gives the number of tables.
RECALL = 0.98
#: Of 128 sign bits so many may differ before exact ranking: a pair of cosine 0.9 differs in 18.4 of them on average (deviation 4.0).
SKETCH_LIMIT = 36
#: A round has at most so many visits, or so many a vector.
ROUND, ROUND_EACH = 4_000_000, 11


def probe_order(hashes: int, probes: int) -> list[list[int]]:
    """The first sets of moves, as positions in the sorted list of the 2 x hashes boundary distances, by expected cost.

    The expected square of the j-th smallest distance is that of order statistics; a set may not hold both moves of
    one hash (positions j and 2 x hashes - 1 - j).
    """
    m = hashes
    j = np.arange(1, m + 1)
    low = j * (j + 1) / (4 * (m + 1) * (m + 2))
    j = np.arange(m + 1, 2 * m + 1)
    high = 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2))
    cost = np.concatenate([low, high])
    heap = [(float(cost[0]), [0])]
    out: list[list[int]] = []
    while heap and len(out) < probes:
        score, moves = heapq.heappop(heap)
        if all(2 * m - 1 - x not in moves for x in moves):
            out.append(moves)
        last = moves[-1]
        if last + 1 < 2 * m:
            step = float(cost[last + 1])
            heapq.heappush(heap, (score - float(cost[last]) + step, [*moves[:-1], last + 1]))
            heapq.heappush(heap, (score + step, [*moves, last + 1]))
    return out


def hashes_for(rows: int, width: float = WIDTH, occupancy: float = 2.0) -> int:
    """Hashes a table, so that unrelated vectors of a bucket number about occupancy: they meet at distance sqrt 2."""
    r = width / math.sqrt(2)
    meet = 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))
    return max(4, math.ceil(math.log(max(rows, 2) / occupancy) / -math.log(meet)))


def meeting(hashes: int, probes: int, cosine: float, width: float = WIDTH, trials: int = 4000) -> float:
    """The probability that a vector at the cosine is met in one table, by the bucket or a visit of either; by simulation of the hashes."""
    rng = np.random.default_rng(1)
    apart = math.sqrt(2 - 2 * cosine)
    low = rng.uniform(0, 1, (trials, hashes))
    other = low + apart * rng.normal(size=(trials, hashes)) / width
    crossed = np.floor(other).astype(int)
    within = np.abs(crossed).max(axis=1) <= 1
    # the place of each crossing among the vector's own boundary distances, nearest first
    order = np.argsort(np.argsort(np.concatenate([low, 1 - low], axis=1), axis=1), axis=1)
    known = {frozenset()} | {frozenset(m) for m in probe_order(hashes, probes)}
    hit = 0
    for row, places, fine in zip(crossed, order, within):
        if fine:
            hit += frozenset([int(places[j + (hashes if c > 0 else 0)]) for j, c in enumerate(row) if c]) in known
    one = hit / trials
    return 1 - (1 - one) ** 2 if one < 1 else 1.0


def tables_for(hashes: int, probes: int, cosine: float, recall: float = RECALL, width: float = WIDTH) -> int:
    """Tables that meet the asked share of the pairs at the cosine; either side's visits count half as one would if they were independent."""
    one = meeting(hashes, probes, cosine, width)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - one))) if one < 1 else 1


class Hasher:
    """The tables' random directions, offsets and keys, the same in every task."""

    def __init__(self, dim: int, hashes: int, tables: int, probes: int = PROBES, width: float = WIDTH, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hashes, self.tables, self.width = hashes, tables, width
        self.a = rng.normal(size=(dim, tables * hashes)).astype(np.float32)
        self.b = rng.uniform(0, width, tables * hashes).astype(np.float32)
        self.key = rng.integers(1, 2**63, (tables, hashes), dtype=np.uint64) | np.uint64(1)
        self.table_key = rng.integers(1, 2**63, tables, dtype=np.uint64)
        self.signs = rng.normal(size=(dim, 128)).astype(np.float32)
        self.moves = probe_order(hashes, probes)

    def sketch(self, x: np.ndarray) -> np.ndarray:
        """(rows, 2): the sign bits."""
        bits = (x @ self.signs) > 0
        return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).view(np.int64)

    def buckets(self, x: np.ndarray, first: int, last: int, visits: bool) -> np.ndarray:
        """(rows, (last - first) x (1 + probes)) bucket keys of the tables from first up to last; the first of every table is the vector's own, and without visits the only one."""
        n, t, m = len(x), last - first, self.hashes
        part, key = slice(first * m, last * m), self.key[first:last]
        place = ((x @ self.a[:, part] + self.b[part]) / np.float32(self.width)).reshape(n, t, m)
        own = np.floor(place)
        low = place - own
        moved = self.moves if visits else []
        with np.errstate(over="ignore"):
            base = (own.astype(np.int64).view(np.uint64) * key).sum(axis=2, dtype=np.uint64) + self.table_key[first:last]
            out = np.empty((n, t, 1 + len(moved)), dtype=np.uint64)
            out[:, :, 0] = base
            if moved:
                near = np.argsort(np.concatenate([low, 1 - low], axis=2), axis=2)  # moves below m go down, the others up
                which = np.broadcast_to(key[None], (n, t, m))
                step = np.concatenate([np.uint64(0) - which, which], axis=2)
                step = np.take_along_axis(step, near, axis=2)
            for k, moves in enumerate(moved):
                out[:, :, k + 1] = base + step[:, :, moves].sum(axis=2, dtype=np.uint64)
            out ^= out >> np.uint64(31)
            out *= np.uint64(0x9E3779B97F4A7C15)
        return out.reshape(n, -1).view(np.int64)


def usable(vector: str | Column, dim: int) -> Column:
    """Whether an embedding takes part: dim finite values, not all zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce((F.size(v) == dim) & fine, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, dtype=np.float64).reshape(-1, dim)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class MultiprobeIndex:
    """rows (key, vector) as hash tables in the shared folder.

    Unusable vectors (null, of another length, all zero, not finite) take no part. A key delivered twice counts once, with
    its smallest vector. Equal vectors are one class: the tables hold its smallest key, members has all its keys. The number of
    tables follows from the rows, so that pairs at the cosine least_cosine are met with the expected RECALL at every size. An
    empty table has no neighbours.
    """

    def __init__(self, rows: DataFrame, key: str, vector: str, dim: int = 64, k: int = 10, least_cosine: float = 0.9, tables: int | None = None, probes: int = PROBES, width: float = WIDTH, scratch: Scratch | None = None):
        self.spark, self.k, self.dim = rows.sparkSession, k, dim
        self.scratch = scratch or Scratch(self.spark, "vectors")
        with freeing(self.spark):
            rows = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector")).where(F.col("key").isNotNull())
            fine = rows.where(usable("vector", dim))
            # equal vectors go by 128 bits of hashes, and only these are shuffled to find the classes
            two = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")]
            seen = fine.select("key", *two).groupBy("key").agg(*[f(h).alias(f"{f.__name__}_{h}") for h in ("h1", "h2") for f in (F.min, F.max)])
            seen = self.scratch.write("seen", seen.select("key", F.col("min_h1").alias("h1"), F.col("min_h2").alias("h2"), F.expr("min_h1 = max_h1 AND min_h2 = max_h2").alias("one")))
            keyed, odd = seen.where("one").select("key", "h1", "h2"), seen.where("NOT one").select("key")
            if not odd.isEmpty():  # keys with several vectors
                least = self.scratch.write("least", fine.join(odd, "key").groupBy("key").agg(F.min("vector").alias("vector")).select("key", *two))
                keyed = keyed.unionByName(least)
            classes = keyed.groupBy("h1", "h2").agg(F.min("key").alias("key"), F.count("*").alias("n"))
            classes = self.scratch.write("classes", classes.withColumn("id", F.xxhash64(F.col("key").cast("string"))))
            several = classes.where("n > 1").select("h1", "h2", "id")
            self.members = self.scratch.write("members", keyed.join(several, ["h1", "h2"]).select("id", "key"))
            # the k + 1 smallest keys of each class of several, a hot class cut down part by part first
            part = Window.partitionBy("id", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy("key")
            few = self.members.withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= k + 1)
            few = few.withColumn("__r", F.row_number().over(Window.partitionBy("id").orderBy("key"))).where(F.col("__r") <= k + 1)
            heads = few.groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("heads"))  # k + 1 of them
            named = classes.join(heads, "id", "left").select("key", "h1", "h2", "id", F.coalesce("heads", F.array("key")).alias("heads"))
            both = rows.select("key", "vector", *two).join(named, ["key", "h1", "h2"])
            self.vectors = self.scratch.write("vectors", both.groupBy("key", "h1", "h2").agg(F.first("id").alias("id"), F.first("vector").alias("vector"), F.first("heads").alias("heads")).select("id", "vector", "heads"))
        for name in ("seen", "least", "classes"):
            self.scratch.drop(name)
        self.rows = self.vectors.count()
        hashes = hashes_for(self.rows, width)
        self.hasher = Hasher(dim, hashes, tables or tables_for(hashes, probes, least_cosine, RECALL, width), probes, width)

    def _hashed(self, vectors: DataFrame, first: int, last: int, visits: bool) -> DataFrame:
        """(bucket, id, s, t): the buckets of vectors in the tables from first up to last, with or without those visited, and the two halves of the sign bits."""
        hasher, dim = self.hasher, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _units(_matrix(b.column(1), dim)).astype(np.float32)
                    keys, signs = hasher.buckets(x, first, last, visits), hasher.sketch(x)
                    offsets = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signs[:, 0]), pa.array(signs[:, 1]), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=["id", "s", "t", "keys"])

        each = vectors.select("id", "vector").mapInArrow(run, "id bigint, s bigint, t bigint, keys array<bigint>")
        return each.select(F.explode("keys").alias("bucket"), "id", "s", "t")

    def candidates(self, sketch_limit: int = SKETCH_LIMIT) -> DataFrame:
        """(a, b), a < b: pairs that meet in a bucket, by either's visits, and whose sign bits differ in at most sketch_limit places."""
        n, each, tables = max(self.rows, 1), 1 + len(self.hasher.moves), self.hasher.tables
        most = max(ROUND, ROUND_EACH * n)
        together, parts = max(1, most // (n * each)), math.ceil(n * each / most)
        differing = F.bit_count(F.col("s").bitwiseXOR(F.col("own_s"))) + F.bit_count(F.col("t").bitwiseXOR(F.col("own_t")))
        paths = []
        with freeing(self.spark):
            for first in range(0, tables, together):
                last = min(tables, first + together)
                own = self._hashed(self.vectors, first, last, visits=False)
                if parts > 1:
                    own = self.scratch.write("own", own)
                own = own.select("bucket", F.col("id").alias("b"), F.col("s").alias("own_s"), F.col("t").alias("own_t")).hint("shuffle_hash")
                for part in range(parts):
                    visits = self._hashed(self.vectors.where(F.pmod("id", F.lit(parts)) == part), first, last, visits=True)
                    met = visits.join(own, "bucket").where((F.col("id") != F.col("b")) & (differing <= sketch_limit))
                    self.scratch.write(name := f"met-{first}-{part}", met.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct())
                    paths.append(self.scratch.path(name))
            self.scratch.drop("own")
            pairs = self.scratch.write("pairs", self.spark.read.schema("a bigint, b bigint").parquet(*paths).distinct())
        for path in paths:
            self.scratch.drop(path.rpartition("/")[2])
        return pairs

    def similar(self, least_cosine: float, sketch_limit: int = SKETCH_LIMIT) -> DataFrame:
        """(id, neighbour, cosine), both ways: pairs of classes of at least the cosine, exact for every candidate."""
        candidates = self.candidates(sketch_limit)
        dim, parts = self.dim, 2 if self.rows * (1 + len(self.hasher.moves)) > ROUND else 1
        part = lambda rows, x, i: rows.where(F.pmod(x, F.lit(parts)) == i) if parts > 1 else rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cosine = (_units(_matrix(b.column(2), dim)) * _units(_matrix(b.column(3), dim))).sum(axis=1)
                    out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cosine)], names=["a", "b", "cosine"])
                    yield out.filter(pa.array(cosine >= least_cosine))

        paths = []
        with freeing(self.spark):  # by halves of either side, as a round shuffles the vectors of both
            for i, j in itertools.product(range(parts), repeat=2):
                v, w = part(self.vectors, "id", i), part(self.vectors, "id", j)
                pairs = part(part(candidates, "a", i), "b", j).join(v.select(F.col("id").alias("a"), F.col("vector").alias("va")), "a")
                pairs = pairs.join(w.select(F.col("id").alias("b"), F.col("vector").alias("vb")), "b").select("a", "b", "va", "vb")
                self.scratch.write(name := f"exact-{i}-{j}", pairs.mapInArrow(run, "a bigint, b bigint, cosine double"))
                paths.append(self.scratch.path(name))
        exact = self.spark.read.schema("a bigint, b bigint, cosine double").parquet(*paths)
        side = lambda x, y: F.struct(F.col(x).alias("id"), F.col(y).alias("neighbour"))
        return exact.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p"), "cosine").select("p.id", "p.neighbour", "cosine")

    def nearest(self, least_cosine: float, sketch_limit: int = SKETCH_LIMIT, every_member: bool = True) -> DataFrame:
        """(key, neighbour, cosine, rank): the k nearest of at least the cosine; cosines tie to 9 places, ties go to the smaller key.

        Which of a vector's k nearest have that cosine depends only on vectors that have it too, so the ranks are
        those of the whole table, but for pairs that met in no bucket. Every member of a class of equal vectors has its list;
        with every_member off only the k + 1 smallest keys of a class do, which are all that can be in another's list.
        """
        heads = self.vectors.select(F.col("id").alias("neighbour"), "heads")
        others = self.similar(least_cosine, sketch_limit).join(heads, "neighbour").select("id", F.round("cosine", 9).alias("cosine"), F.explode("heads").alias("neighbour"))
        own = self.vectors.where(F.size("heads") > 1).select("id", F.lit(1.0).alias("cosine"), F.explode("heads").alias("neighbour")).where(F.col("cosine") >= least_cosine)
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
        best = others.unionByName(own).withColumn("__r", place).where(F.col("__r") <= self.k + 1)
        # k + 1 of them, as one may be the key itself
        lists = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("__r", "neighbour", "cosine"))).alias("near"))
        keys = self.vectors.select("id", F.explode("heads").alias("key"))
        if every_member:
            keys = self.vectors.where(F.size("heads") == 1).select("id", F.col("heads")[0].alias("key")).unionByName(self.members)
        mine = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("key")), 1, self.k)
        each = keys.join(lists, "id").select("key", F.posexplode(mine).alias("__p", "n"))
        return each.select("key", "n.neighbour", "n.cosine", (F.col("__p") + 1).alias("rank"))


def mutual(nearest: DataFrame) -> DataFrame:
    """(key_a, key_b, cosine), key_a < key_b: pairs each among the other's nearest."""
    ordered = nearest.select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b"), "cosine")
    return ordered.groupBy("key_a", "key_b").agg(F.count("*").alias("n"), F.max("cosine").alias("cosine")).where("n = 2").drop("n")
