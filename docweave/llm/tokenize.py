"""Encoding of a corpus with a public byte-level BPE tokenizer by merge replay.

A batch of texts is cut into words; words not met before are laid out in one array of byte tokens.
An inverted index from token pair to the positions of that pair is built over all of them, and every
merge that occurs is applied in rank order at all its positions at once, only the neighbours of a
position being indexed anew. Texts then take their ids word by word. Words are independent of each
other, so each task replays the words of its own rows and nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Folder with the vocabulary files of the public tokenizers.
FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
#: Fixed value: how GPT-2's byte-level BPE cuts text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their ids in a task; when there are more, the memory is emptied and they are replayed again.
REMEMBERED = 200_000


def _byte_signs() -> dict[str, int]:
    """The printable sign for each byte in the vocabulary file, after the published byte-level scheme."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeReplay:
    """The merges of one vocabulary file, and the words already encoded."""

    def __init__(self, file: bytes):
        import regex

        model = json.loads(file)["model"]
        vocab = model["vocab"]
        signs = _byte_signs()
        self.first = [0] * 256
        for sign, byte in signs.items():
            self.first[byte] = vocab[sign]
        #: pair -> (rank, id of the merged token)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.by_rank: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merged = (vocab[a], vocab[b], vocab[a + b])
            self.merges[merged[:2]] = (rank, merged[2])
            self.by_rank.append(merged)
        self.cut = regex.compile(WORDS).findall
        self.known: dict[str, list[int]] = {}

    def replay(self, words: list[str]) -> None:
        """Encodes words together and adds them to known."""
        token: list[int] = []
        before: list[int] = []
        after: list[int] = []
        starts = []
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            start, end = len(token), len(token) + len(raw)
            starts.append(start)
            token += [self.first[b] for b in raw]
            before += [-1, *range(start, end - 1)]
            after += [*range(start + 1, end), -1]
        index: dict[int, list[int]] = {}
        merges = self.merges
        for i, j in enumerate(after):
            if j >= 0 and (m := merges.get((token[i], token[j]))):
                index.setdefault(m[0], []).append(i)
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            a, b, merged = self.by_rank[rank]
            for i in sorted(index.pop(rank)):  # from left to right, for runs such as aaa
                j = after[i]
                if token[i] != a or j < 0 or token[j] != b:
                    continue  # a part of it was merged in the meantime
                token[i], token[j] = merged, -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                for x, y in ((before[i], i), (i, k)):
                    if x >= 0 and y >= 0 and (m := merges.get((token[x], token[y]))):
                        if m[0] not in index:
                            index[m[0]] = []
                            heapq.heappush(queue, m[0])
                        index[m[0]].append(x)
        for w, i in zip(words, starts):
            ids = []
            while i >= 0:
                ids.append(token[i])
                i = after[i]
            self.known[w] = ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; null and empty texts have none."""
        cut = [self.cut(t) if t else () for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        if new := list(dict.fromkeys(w for words in cut for w in words if w not in known)):
            self.replay(new)
        return [[i for w in words for i in known[w]] for words in cut]


@lru_cache(maxsize=2)
def replayer(file: bytes) -> MergeReplay:
    """One for each worker process."""
    return MergeReplay(file)


def encode_corpus(df: DataFrame, text: str, ids: str = "ids", count: str | None = None, vocabulary: str = "byte_bpe_50k.json", folder: str | None = None, batch: int = 256) -> DataFrame:
    """df without text, with its token ids as an array of integers, or with their number if count names a column.

    Special tokens are never added, and their strings in a text are ordinary text. An empty text has no ids ([]),
    and so has a null text, which makes the result defined for every row. Texts are read whole; a very long text is
    one row of one batch. No shuffle; each row comes out once, ties, repeated rows and empty tables included.
    """
    path = f"{folder or FOLDER}/{vocabulary}"
    name = count or ids
    kept = [c for c in df.columns if c != text]
    if name in kept:
        raise ValueError(f"column {name} is there already")
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(name, T.IntegerType() if count else T.ArrayType(T.IntegerType()))])

    with open(path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary, a few MB; executors need no copy of it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = replayer(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                coded = replay.encode(part.column(len(kept)).to_pylist())
                values = pa.array([len(c) for c in coded], pa.int32()) if count else pa.array(coded, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], values], names=[*kept, name])

    return df.select(*kept, text).mapInArrow(run, schema)
