"""New batches against all history: exact and near duplicates through a segment index for edit distance.

A text's set of word shingles is written as a string: its distinct shingles as symbols in one global order, rare ones first.
Inserting and deleting symbols is all that tells two such strings apart, so their edit distance is the size of the sets'
symmetric difference, and a Jaccard similarity of at least s for a and b symbols is an edit distance of at most
(1 - s) / (1 + s) x (a + b). A string of n symbols is cut into a number of segments that n fixes: its first symbols one by one,
as many as a partner may lack and SHARED more, and the rest. Only deletions spoil a segment of one symbol, so strings within the
distance have SHARED of them in common. Segments of two symbols, which insertions spoil too, need nearly the whole string (0.86 of
it for a similarity of 0.7) instead of its rarest third; README has the measurements. Segments are stored with the length
and position; a batch probes with its own, the join drops what length and position put out of reach, and the edit distance of
what is left is verified against its bound. The segments of accepted strings are appended to the folder.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.keys import norm_key
from docweave.operators.bits import BitFilter
from docweave.operators.skew import salted_join
from docweave.session import Scratch

#: Segments that strings within the distance must share: each string has as many more of them, so that none is missed.
SHARED = 3
#: Cells of the hashed shingle counts that give the order of symbols: 4 MB, whatever the corpus. Any order gives whole results.
ORDER_BITS = 20
#: Bits of a shingle's hash that are kept; the others hold the text's number while a batch is sorted. Two texts of 1000 shingles
#: have a wrong match with a probability of a millionth.
HASH_BITS = 40
SYMBOL_BYTES = HASH_BITS // 8
#: Rows of a batch that are hashed together; their numbers fit the other bits.
TOGETHER = 1000
#: Cells that note which segments occur in several strings: at most 2^26, 8 MB. Fewer cells drop less before the shuffle, never too much.
MOST_CELL_BITS = 26
CHUNKS = 64
#: Links up to this number are settled in one task, 32 bytes each; more of them in rounds.
ONE_TASK = 2_000_000
NO_BATCH = 2**62
_TOKENS = re.compile(r"[^\W_]+|\x00").findall
_MOST_WORDS = 500_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Words(dict):
    """Hashes of the words met so far."""

    def __missing__(self, word: str) -> int:
        if len(self) > _MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()
_BREAK = np.uint64(xxhash.xxh3_64_intdigest("\x00"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def strings(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, sizes): the distinct shingles of each of at most TOGETHER texts in ascending order, one text after another."""
    whole = "\x00".join([t.replace("\x00", " ") if t else "" for t in texts]).lower()
    found = _TOKENS(whole)
    words = np.fromiter(map(_words.__getitem__, found), dtype=np.uint64, count=len(found))
    breaks = words == _BREAK
    of = np.cumsum(breaks)
    n = max(0, len(words) - width + 1)
    fits = ~breaks[:n] & (of[:n] == of[width - 1 :]) if n else np.zeros(0, dtype=bool)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = (h ^ words[k : k + n]) * _M1 + _M2
            h ^= h >> np.uint64(29)
        h = _mixed(h)
    keyed = (of[:n][fits].astype(np.uint64) << np.uint64(HASH_BITS)) | (h[fits] >> np.uint64(64 - HASH_BITS))
    keyed.sort()
    new = np.ones(len(keyed), dtype=bool)
    new[1:] = keyed[1:] != keyed[:-1]
    keyed = keyed[new]
    sizes = np.bincount((keyed >> np.uint64(HASH_BITS)).astype(np.int64), minlength=len(texts))
    return keyed & np.uint64((1 << HASH_BITS) - 1), sizes


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, dtype=np.int64)


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes * SYMBOL_BYTES)]).astype(np.int32)
    packed = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SYMBOL_BYTES])
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(packed.tobytes())])


def signed_rows(rows: DataFrame, key: str, batch: str, text: str, width: int) -> DataFrame:
    """(key, batch, h1, h2, n, body) of every row with a shingle, from one pass over the texts.

    body is the string, SYMBOL_BYTES a symbol; h1 and h2 name it by 128 bits; a null batch is the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(at, TOGETHER)
                h, sizes = strings(b.column(2).to_pylist(), width)
                there = np.flatnonzero(sizes)
                if not len(there):
                    continue
                n = sizes[there]
                starts = _starts(n)
                with np.errstate(over="ignore"):
                    names = [_mixed(np.add.reduceat(_mixed(h + salt), starts) + n.astype(np.uint64) * _M2).view(np.int64) for salt in (_M1, _M3)]
                taken = pa.array(there)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(taken), b.column(1).take(taken), pa.array(names[0]), pa.array(names[1]), pa.array(n.astype(np.int32)), _binary(h, n)],
                    names=["key", "batch", "h1", "h2", "n", "body"],
                )

    picked = rows.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(batch).cast("bigint"), F.lit(NO_BATCH)).alias("batch"), F.col(text).alias("text"))
    return picked.where("key IS NOT NULL").mapInArrow(run, "key bigint, batch bigint, h1 bigint, h2 bigint, n int, body binary")


# ---- the cut of a string


def most_edits(a: np.ndarray, b: np.ndarray, s: float) -> np.ndarray:
    """The edit distance that strings of a and b symbols of similarity s may have."""
    return np.floor((1 - s) / (1 + s) * (a + b) + 1e-9).astype(np.int64)


def segment_count(n: np.ndarray, s: float) -> np.ndarray:
    """The segments of one symbol of a string of n: what a partner of similarity s may lack, and SHARED."""
    return np.minimum(n, n - np.ceil(s * n - 1e-9).astype(np.int64) + SHARED)


def _order_cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(HASH_BITS - ORDER_BITS)).astype(np.int64)


def segments(h: np.ndarray, sizes: np.ndarray, s: float, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, text, position) of the segments of at most TOGETHER strings, rare symbols first."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    rank = (of.astype(np.uint64) << np.uint64(HASH_BITS)) | (order[_order_cells(h)].astype(np.uint64) << np.uint64(HASH_BITS - 31)) | (h & np.uint64((1 << (HASH_BITS - 31)) - 1))
    h = h[np.argsort(rank, kind="stable")]
    place = np.arange(len(h)) - np.repeat(_starts(sizes), sizes)
    keep = place < segment_count(sizes, s)[of]
    return h[keep], of[keep], place[keep]


def _bodies_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = column.to_pylist()
    packed = np.frombuffer(b"".join(values), dtype=np.uint8).reshape(-1, SYMBOL_BYTES)
    wide = np.zeros((len(packed), 8), dtype=np.uint8)
    wide[:, :SYMBOL_BYTES] = packed
    return wide.view("<u8").reshape(-1), np.array([len(v) // SYMBOL_BYTES for v in values], dtype=np.int64)


def _parts(whole: pa.RecordBatch, rows: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    for at in range(0, whole.num_rows, rows):
        yield whole.slice(at, rows)


# ---- which segments several strings have


def cell_bits(symbols: int) -> int:
    """Four cells for each symbol, within the bound."""
    return min(MOST_CELL_BITS, max(16, math.ceil(math.log2(max(symbols, 1) * 4))))


def _merged(parts: DataFrame, add, width: int) -> dict[int, bytes]:
    """Chunks of one fixed size, of all tasks, put together by add on the executors: CHUNKS rows come to the driver."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, tuple] = {}
        for b in batches:
            for chunk, *values in zip(*(c.to_pylist() for c in b.columns)):
                done[chunk] = add(done.get(chunk), values)
        arrays = [pa.array([v[k].tobytes() for v in done.values()], pa.binary()) for k in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.int32()), *arrays], names=["chunk", *(f"v{k}" for k in range(width))])

    kind = ", ".join(["chunk int", *(f"v{k} binary" for k in range(width))])
    return {r[0]: r[1:] for r in parts.repartition(8, "chunk").mapInArrow(merge, kind).collect()}


def _chunked(*arrays: np.ndarray) -> pa.RecordBatch:
    parts = [pa.array([x.tobytes() for x in a.reshape(CHUNKS, -1)], pa.binary()) for a in arrays]
    return pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), *parts], names=["chunk", *(f"v{k}" for k in range(len(arrays)))])


def _whole(chunks: dict[int, tuple], k: int, kind, size: int) -> np.ndarray:
    out = np.zeros((CHUNKS, size // CHUNKS), dtype=kind)
    for chunk, values in chunks.items():
        out[chunk] = np.frombuffer(values[k], dtype=kind)
    return out.reshape(-1)


def symbol_order(signed: DataFrame) -> np.ndarray:
    """How often the shingles of each cell occur in all strings: 2^ORDER_BITS counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, dtype=np.int64)
        for b in batches:
            for part in _parts(b):
                total += np.bincount(_order_cells(_bodies_of(part.column(0))[0]), minlength=1 << ORDER_BITS)
        if total.any():
            yield _chunked(np.minimum(total, 2**31 - 1).astype(np.int32))

    def add(had: tuple | None, values: list) -> tuple:
        x = np.frombuffer(values[0], dtype=np.int32).astype(np.int64)
        return (np.minimum(x if had is None else had[0] + x, 2**31 - 1).astype(np.int32),)

    return _whole(_merged(signed.select("body").mapInArrow(count, "chunk int, v0 binary"), add, 1), 0, np.int32, 1 << ORDER_BITS)


def _note(cells: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(cells, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _noted(cells: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((cells[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _cell(symbols: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mixed(symbols * _M1) >> np.uint64(64 - bits)).astype(np.int64)


def several(classes: DataFrame, s: float, order: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(once, twice): one bit a cell, set where a segment of any string, or segments of several, fall."""
    size = (1 << bits) // 8
    shared = classes.sparkSession.sparkContext.broadcast(order)  # 4 MB

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, dtype=np.uint8), np.zeros(size, dtype=np.uint8)
        for whole in batches:
            for b in _parts(whole):
                at = np.sort(_cell(segments(*_bodies_of(b.column(0)), s, shared.value)[0], bits))
                _note(twice, at[_noted(once, at)])
                _note(twice, at[1:][at[1:] == at[:-1]])
                _note(once, at)
        if once.any():
            yield _chunked(once, twice)

    def add(had: tuple | None, values: list) -> tuple:
        once, twice = (np.frombuffer(v, dtype=np.uint8) for v in values)
        return (once, twice) if had is None else (had[0] | once, had[1] | twice | (had[0] & once))

    chunks = _merged(classes.select("body").mapInArrow(note, "chunk int, v0 binary, v1 binary"), add, 2)
    return _whole(chunks, 0, np.uint8, size), _whole(chunks, 1, np.uint8, size)


def cells_of(stored: DataFrame, bits: int) -> np.ndarray:
    """One bit a cell, set where a stored segment falls."""
    size = (1 << bits) // 8

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.zeros(size, dtype=np.uint8)
        for b in batches:
            _note(there, _cell(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))
        if there.any():
            yield _chunked(there)

    def add(had: tuple | None, values: list) -> tuple:
        x = np.frombuffer(values[0], dtype=np.uint8)
        return (x if had is None else had[0] | x,)

    return _whole(_merged(stored.select("segment").mapInArrow(note, "chunk int, v0 binary"), add, 1), 0, np.uint8, size)


POSTINGS = "segment bigint, class bigint, n int, pos int"


def postings(classes: DataFrame, s: float, order: np.ndarray, wanted: np.ndarray | None = None, bits: int = 0) -> DataFrame:
    """(segment, class, n, pos): one row a segment, with the length of its string; of the wanted cells only where these are given."""
    context = classes.sparkSession.sparkContext
    ranks, shared = context.broadcast(order), None if wanted is None else context.broadcast(wanted)  # 4 MB, 2^bits / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _parts(whole):
                ids = b.column(0).to_numpy(zero_copy_only=False)
                h, sizes = _bodies_of(b.column(1))
                seg, of, pos = segments(h, sizes, s, ranks.value)
                if shared is not None:
                    keep = _noted(shared.value, _cell(seg, bits))
                    # a string with fewer noted segments than it must share with any partner has none
                    left = np.bincount(of[keep], minlength=len(sizes))
                    keep &= (left >= np.minimum(SHARED, np.ceil(s * sizes - 1e-9)))[of]
                    seg, of, pos = seg[keep], of[keep], pos[keep]
                arrays = [pa.array(seg.view(np.int64)), pa.array(ids[of]), pa.array(sizes[of].astype(np.int32)), pa.array(pos.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["segment", "class", "n", "pos"])

    return classes.select("class", "body").mapInArrow(run, POSTINGS)


def within_cells(stored: DataFrame, cells: np.ndarray, bits: int) -> DataFrame:
    """The stored segments that fall into noted cells."""
    shared = stored.sparkSession.sparkContext.broadcast(cells)  # 2^bits / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_noted(shared.value, _cell(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))))

    return stored.mapInArrow(run, POSTINGS)


def candidates(stored: DataFrame, probes: DataFrame, s: float, ordered: bool) -> DataFrame:
    """(a, b): stored strings a and probing strings b that share enough segments at lengths and positions within the distance.

    By the pigeonhole principle that is SHARED of them, or all that must be shared where that is fewer. ordered: only a < b.
    """
    x = stored.select("segment", F.col("class").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    y = probes.select("segment", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    near = (F.col("na") >= F.col("nb") * s - 1e-9) & (F.col("nb") >= F.col("na") * s - 1e-9)
    needed = (F.col("na") + F.col("nb")) * (s / (1 + s)) - 1e-9
    # before the first SHARED shared symbols there are fewer than SHARED others
    reach = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= needed - (SHARED - 1)
    apart = F.col("a") < F.col("b") if ordered else F.col("a") != F.col("b")
    met = x.join(y, "segment").where(apart & near & reach)
    shared = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first(F.least(F.lit(float(SHARED)), F.ceil(needed))).alias("least"))
    return shared.where(F.col("shared") >= F.col("least")).select("a", "b")


def verify(pairs: DataFrame, bodies: DataFrame, s: float) -> DataFrame:
    """(a, batch_a, b, batch_b): the pairs whose edit distance is within the bound of their lengths, the earlier one as a."""
    one, two = (bodies.select(F.col("class").alias(x), F.col("batch").alias(f"batch_{x}"), F.col("body").alias(f"body_{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "batch_a", "b", "batch_b", "body_a", "body_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _parts(whole, 500):
                n = b.num_rows
                sides, sizes = [], []
                for c in (4, 5):
                    h, size = _bodies_of(b.column(c))
                    sides.append((np.repeat(np.arange(n), size).astype(np.uint64) << np.uint64(HASH_BITS)) | h)
                    sizes.append(size)
                merged = np.sort(np.concatenate(sides))
                twice = merged[1:][merged[1:] == merged[:-1]] >> np.uint64(HASH_BITS)
                kept = np.bincount(twice.astype(np.int64), minlength=n)
                distance = sizes[0] + sizes[1] - 2 * kept
                yield b.select(["a", "batch_a", "b", "batch_b"]).filter(pa.array(distance <= most_edits(sizes[0], sizes[1], s)))

    true = both.mapInArrow(run, "a bigint, batch_a bigint, b bigint, batch_b bigint")
    late = F.struct("batch_a", "a") > F.struct("batch_b", "b")
    return true.select(*[F.when(late, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("batch_a", "batch_b"), ("b", "a"), ("batch_b", "batch_a"))])


# ---- which strings are accepted


def _settle_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1) for b in batches if b.num_rows]
    links = np.concatenate(read) if read else np.zeros((0, 4), dtype=np.int64)
    links = links[np.lexsort((links[:, 2], links[:, 3]))]  # by the later class
    repeated: set[int] = set()
    for a, _, b, _ in links.tolist():
        if a not in repeated:
            repeated.add(b)
    out = list(repeated)
    yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["class"])


def settle(links: DataFrame, scratch: Scratch, label: str = "settle", one_task: int = ONE_TASK) -> DataFrame:
    """(class): the later classes of links (a, batch_a, b, batch_b) that are repeats: an accepted class comes before them.

    A class is accepted unless it is linked to an accepted one before it. Up to one_task links are gone through in order by
    one task; more of them in rounds, each of which decides every class whose earlier neighbours are decided, so that there
    are as many rounds as the longest chain of links.
    """
    if links.count() <= one_task:
        return scratch.write(label, links.select("a", "batch_a", "b", "batch_b").coalesce(1).mapInArrow(_settle_here, "class bigint"))
    # a class is open while an earlier neighbour is; rows are (class, repeated), null while open
    later = links.select(F.col("b").alias("class")).distinct()
    state, turn = scratch.write(f"{label}0", later.select("class", F.lit(None).cast("boolean").alias("repeated"))), 0
    while not state.where("repeated IS NULL").isEmpty():
        open_b = state.where("repeated IS NULL").select(F.col("class").alias("b"))
        known = state.select(F.col("class").alias("a"), F.col("repeated"), F.lit(True).alias("__later"))
        # a class that is never later is accepted from the beginning
        of_a = F.when(F.col("__later").isNull(), F.lit(False)).otherwise(F.col("repeated"))
        seen = links.join(open_b, "b", "left_semi").join(known, "a", "left").select(F.col("b").alias("class"), of_a.alias("of_a"))
        verdict = seen.groupBy("class").agg(F.max(F.coalesce(~F.col("of_a"), F.lit(False))).alias("hit"), F.max(F.col("of_a").isNull()).alias("wait"))
        turn += 1
        decided = F.coalesce("repeated", F.when(F.col("hit"), F.lit(True)).when(~F.col("wait"), F.lit(False)))
        state = scratch.write(f"{label}{turn}", state.join(verdict, "class", "left").select("class", decided.alias("repeated")))
        if turn > 1:
            scratch.drop(f"{label}{turn - 2}")
    return state.where("repeated").select("class")


def earliest_key(near: Column, batch: Column, key: Column) -> Column:
    """The smallest key before (batch, key) in an array of (batch, key), the smallest key of each batch."""
    before = F.filter(near, lambda x: (x["batch"] < batch) | ((x["batch"] == batch) & (x["key"] < key)))
    return F.array_min(F.transform(before, lambda x: x["key"]))


def by_batch(rows: DataFrame, group: str, batch: str, key: str) -> DataFrame:
    """(group, near): the smallest key of each batch, as an array with one entry a batch: within a batch keys are the order."""
    least = rows.groupBy(group, F.col(batch).alias("batch")).agg(F.min(key).alias("key"))
    return least.groupBy(group).agg(F.collect_list(F.struct("batch", "key")).alias("near"))


class Accepted:
    """The accepted rows of all batches so far, as strings and segments in a folder; add() takes the next batches.

    A row is accepted unless an accepted row before it has a similarity of at least s: the Jaccard similarity of their sets of
    width consecutive words, words being runs of letters and digits in lower case. Texts of fewer words (null and empty ones
    too) are accepted and nothing's copy. Rows are in the order of batch and key; a null batch comes last, a row with a null
    key does not count, a key delivered twice counts once, with its earliest batch.

    An add costs one pass over its own texts, a probe of its substrings against the stored segments, and the verification of
    what they share; the texts of the history are not read again. All state is in the folder, so that another object, session
    or machine goes on where this one ended. Every add has a number; what it writes counts once its mark is written, and an
    add made again under its number replaces what it wrote before.
    """

    def __init__(self, spark: SparkSession, folder: str, width: int = 3, s: float = 0.7):
        self.spark, self.folder, self.width, self.s = spark, folder, width, s

    def _path(self, name: str, number: int) -> str:
        return f"{self.folder}/{name}/add={number}"

    def numbers(self) -> list[int]:
        """The numbers of the adds that are complete."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/done")
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        done = [x.getPath() for x in fs.listStatus(where) if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def _stored(self, name: str, before: list[int], schema: str) -> DataFrame | None:
        return self.spark.read.schema(schema).parquet(*[self._path(name, k) for k in before]) if before else None

    def add(self, rows: DataFrame, key: str, batch: str, text: str, number: int | None = None, last: bool = False) -> DataFrame:
        """(kept, repeated) of the new rows, which are after all earlier adds: each repeat with the smallest accepted key it fits.

        rows may hold several batches. number: of this add, by default the next; last: nothing is added afterwards, so
        nothing is stored. An empty table gives no row.
        """
        done = self.numbers()
        number = (done[-1] + 1 if done else 1) if number is None else number
        before = [k for k in done if k < number]
        if before:
            held = self.spark.read.parquet(self._path("done", before[-1])).first()
            if (held["width"], held["s"]) != (self.width, self.s):
                raise ValueError(f"the folder was begun with width {held['width']} and similarity {held['s']}")
        scratch, s = Scratch(self.spark, "batch"), self.s
        signed = scratch.write("signed", signed_rows(rows, key, batch, text, self.width))
        named = signed.groupBy("key").agg(F.min(F.struct("batch", "h1", "h2")).alias("r"), F.count("*").alias("times"), F.max("n").alias("n"))
        named = named.select("key", "r.*", "times", "n")
        first = named.groupBy("h1", "h2").agg(F.min(F.struct("batch", "key")).alias("at"))
        # a class is a set of shingles; it goes by the key of its first row
        members = named.join(first, ["h1", "h2"]).select(F.col("at.key").alias("class"), F.col("at.batch").alias("first"), "batch", "key", "h1", "h2", "times", "n")
        members = scratch.write("members", members)
        classes = self._one_a_class(signed, members)
        heads = F.least(F.col("n"), F.col("n") - F.ceil(F.col("n") * F.lit(s)) + SHARED)
        symbols = members.agg(F.coalesce(F.sum(heads), F.lit(0))).first()[0]
        order = self._order(signed, before, number, last)
        if not symbols:
            self._commit(number, None, order, last)
            return self.spark.createDataFrame([], "kept bigint, repeated bigint")
        bits = cell_bits(symbols)
        once, wanted = several(classes, s, order, bits)
        old = self._stored("segments", before, POSTINGS)
        if old is not None:
            # of history's segments only those are shuffled that the new strings may meet
            old = scratch.write("old", within_cells(old, once, bits))
            wanted = wanted | cells_of(old, bits)
        posted = scratch.write("postings", postings(classes, s, order, wanted, bits))
        pairs = candidates(posted, posted, s, ordered=True)
        pairs = scratch.write("pairs", pairs if old is None else pairs.unionByName(candidates(old, posted, s, ordered=False)))
        scratch.drop("postings")
        needed = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        bodies = self._bodies(signed, members, needed)
        if old is not None:
            past = self._stored("rows", before, "class bigint, batch bigint, body binary")
            maybe = BitFilter(needed, "class").maybe("class")
            bodies = bodies.unionByName(past.where(maybe).join(needed, "class", "left_semi"))
        links = scratch.write("links", verify(pairs, bodies, s))
        repeated = settle(links, scratch)
        if last:
            scratch.drop("signed")
        found = scratch.write("found", self._repeats(members, links, repeated))
        if not last:
            kept = members.select("class", "key", "h1", "h2").where("class = key").join(repeated, "class", "left_anti")
            self._commit(number, self._bodies(signed, members, kept.select("class")), order, last)
        return found

    @staticmethod
    def _one_a_class(signed: DataFrame, members: DataFrame) -> DataFrame:
        """(class, body): one row a class. A bit filter tells most first rows without a join; only the rest is joined."""
        doubt = BitFilter(members.where("key <> class OR times > 1"), "key").maybe("key")
        firsts = members.where("key = class").select("key", "h1", "h2")
        sure = signed.where(~doubt).select(F.col("key").alias("class"), "body")
        other = signed.where(doubt).join(firsts, ["key", "h1", "h2"], "left_semi").dropDuplicates(["key"]).select(F.col("key").alias("class"), "body")
        return sure.unionByName(other)

    @staticmethod
    def _bodies(signed: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
        """(class, batch, body) of the wanted classes."""
        firsts = members.where("key = class").join(wanted, "class", "left_semi").select("key", "h1", "h2", F.col("first"))
        maybe = BitFilter(wanted, "class").maybe("key")
        found = signed.where(maybe).select("key", "h1", "h2", "body").join(firsts, ["key", "h1", "h2"]).dropDuplicates(["key"])
        return found.select(F.col("key").alias("class"), F.col("first").alias("batch"), "body")

    @staticmethod
    def _repeats(members: DataFrame, links: DataFrame, repeated: DataFrame) -> DataFrame:
        """(kept, repeated) of the rows, from the classes that are repeats; a class without links is accepted."""
        both = links.select("a", "batch_a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("batch_b").alias("batch_a"), F.col("a").alias("b")))
        taken = both.join(repeated.select(F.col("class").alias("a")), "a", "left_anti").join(repeated.select(F.col("class").alias("b")), "b", "left_semi")
        near = by_batch(taken, "b", "batch_a", "a").withColumnRenamed("b", "class")
        # what a row may repeat: the first row of its own class if that is accepted, else the accepted classes like it
        joined = members.join(near, "class", "left").withColumn("near", F.coalesce("near", F.array(F.struct(F.col("first").alias("batch"), F.col("class").alias("key")))))
        kept = earliest_key(F.col("near"), F.col("batch"), F.col("key"))
        return joined.select(kept.alias("kept"), F.col("key").alias("repeated")).where(F.col("kept").isNotNull())

    def _order(self, signed: DataFrame, before: list[int], number: int, last: bool) -> np.ndarray:
        """The counts that order the symbols: those of the first add, kept in the folder for all later ones."""
        if before:
            return np.frombuffer(self.spark.read.parquet(self._path("order", before[0])).first()[0], dtype=np.int32)
        order = symbol_order(signed)
        if not last:
            self.spark.createDataFrame([(bytearray(order.tobytes()),)], "counts binary").coalesce(1).write.mode("overwrite").parquet(self._path("order", number))
        return order

    def _commit(self, number: int, accepted: DataFrame | None, order: np.ndarray, last: bool) -> None:
        """Writes the strings and segments of an add, then its mark; all of it in the place of an earlier try."""
        if last:
            return
        kind = "class bigint, batch bigint, body binary"
        rows = accepted if accepted is not None else self.spark.createDataFrame([], kind)
        rows.write.mode("overwrite").parquet(self._path("rows", number))
        rows = self.spark.read.schema(kind).parquet(self._path("rows", number))
        postings(rows, self.s, order).write.mode("overwrite").parquet(self._path("segments", number))
        self.spark.createDataFrame([(self.width, self.s)], "width int, s double").coalesce(1).write.mode("overwrite").parquet(self._path("done", number))


def near_repeats(rows: DataFrame, key: str, batch: str, text: str, width: int = 3, s: float = 0.7) -> DataFrame:
    """(kept, repeated): all batches of a table in one add to an empty history; see Accepted."""
    scratch = Scratch(rows.sparkSession, "history")
    return Accepted(rows.sparkSession, scratch.path("accepted"), width, s).add(rows, key, batch, text, last=True)


def same_hash(rows: DataFrame, key: str, batch: str, document: str, digest: str) -> DataFrame:
    """(kept, repeated): rows whose hash an accepted row of another document has, each with the smallest such key before it.

    Hashes compare by their first 32 digits in lower case, a leading sha256: aside; blank and null ones repeat nothing, nor do
    rows of the accepted document itself. Only the document of a hash's first row is ever accepted under it. Null documents
    are one document; a key delivered twice counts once, a null batch comes last.
    """
    text = F.regexp_replace(norm_key(digest), "^sha256:\\s*", "")
    me = F.struct(F.coalesce(F.col(batch).cast("bigint"), F.lit(NO_BATCH)).alias("batch"), F.col(key).cast("bigint").alias("key"))
    rows = rows.select(F.substring(text, 1, 32).alias("hash"), F.coalesce(norm_key(document), F.lit("")).alias("document"), me.alias("me"))
    rows = rows.where(F.col("hash") != "").distinct()
    firsts = rows.groupBy("hash").agg(F.min(F.struct("me", "document")).alias("f"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("hash", F.col("f.document").alias("owner"))
    joined = salted_join(rows, firsts, "hash", "inner", F.col("me")).select("hash", "me.batch", "me.key", (F.col("document") == F.col("owner")).alias("own"))
    near = by_batch(joined.where("own"), "hash", "batch", "key")
    found = salted_join(joined.where("NOT own"), near, "hash", "inner", F.col("key"))
    kept = earliest_key(F.col("near"), F.col("batch"), F.col("key"))
    return found.select(kept.alias("kept"), F.col("key").alias("repeated")).where(F.col("kept").isNotNull())
