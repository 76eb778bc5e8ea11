"""Token ids of whole texts under a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The split of a text into words that belongs to the public vocabulary (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Words up to this many bytes are merged by repeated scans, longer ones by a queue.
SHORT_WORD = 128
#: Words that a task remembers; the memory of what it knows is bounded, nothing else depends on it.
KNOWN_WORDS = 200_000
_NONE = 1 << 60


class ByteBpe:
    """Byte-pair encoding by merge ranks; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.words = regex.compile(SPLIT).findall
        self.known: dict[str, list[int]] = {}

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; an empty or NULL text has none. What looks like a control word is text."""
        ids: list[int] = []
        if not text:
            return ids
        known = self.known
        for word in self.words(text):
            got = known.get(word)
            if got is None:
                got = self.word(word.encode("utf-8", "surrogatepass"))
                if len(word) <= SHORT_WORD:
                    if len(known) >= KNOWN_WORDS:
                        known.clear()
                    known[word] = got
            ids += got
        return ids

    def word(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self._by_scan(data) if len(data) <= SHORT_WORD else self._by_queue(data)

    def _by_scan(self, data: bytes) -> list[int]:
        """Contiguous arrays of part boundaries and of the rank of each adjacent pair.

        The lowest rank is found by a scan, the leftmost of equals first; merging deletes one
        boundary and refreshes the ranks of the two pairs beside it.
        """
        get = self.ranks.get
        bounds = list(range(len(data) + 1))
        pairs = [get(data[i : i + 2], _NONE) for i in range(len(data) - 1)]
        while pairs:
            lowest = min(pairs)
            if lowest == _NONE:
                break
            at = pairs.index(lowest)
            del bounds[at + 1], pairs[at]
            if at < len(pairs):
                pairs[at] = get(data[bounds[at] : bounds[at + 2]], _NONE)
            if at:
                pairs[at - 1] = get(data[bounds[at - 1] : bounds[at + 1]], _NONE)
        return [self.ranks[data[a:b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _by_queue(self, data: bytes) -> list[int]:
        """The same merges for long words in n log n: linked parts and a queue of pairs by rank and place."""
        get, size = self.ranks.get, len(data)
        after, before = list(range(1, size + 2)), list(range(-1, size + 1))
        alive = bytearray(b"\x01" * size)
        queue = [(rank, i, i + 2) for i in range(size - 1) if (rank := get(data[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, left, end = heapq.heappop(queue)
            if not alive[left]:
                continue
            right = after[left]
            if right >= size or after[right] != end:
                continue
            alive[right] = 0
            after[left] = end
            before[end] = left
            if end < size and (rank := get(data[left : after[end]])) is not None:
                heapq.heappush(queue, (rank, left, after[end]))
            if left and (rank := get(data[before[left] : end])) is not None:
                heapq.heappush(queue, (rank, before[left], end))
        parts, at = [], 0
        while at < size:
            parts.append(self.ranks[data[at : after[at]]])
            at = after[at]
        return parts


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteBpe:
    """The tokenizer of a vocabulary file, loaded once in each worker process."""
    return ByteBpe.load(path)


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> str:
    return f"{folder}/{name}.tiktoken"


def _encoder(path: str, ids_of: Callable[[list[list[int]]], pa.Array]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 512):
                coded = [bpe.encode(t) for t in texts.slice(at, 512).to_pylist()]
                result = ids_of(coded)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), result], names=["key", "value"])

    return run


def _id_lists(coded: list[list[int]]) -> pa.Array:
    sizes = np.fromiter((len(x) for x in coded), np.int32, len(coded))
    offsets = np.zeros(len(coded) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    flat = np.empty(int(offsets[-1]), np.int32)
    for x, at in zip(coded, offsets[:-1], strict=True):
        flat[at : at + len(x)] = x
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_texts(documents: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """One row per document with the ids of its whole text; other columns are not read.

    NULL and empty texts have an empty list. Repeated keys give repeated rows. A map over the
    rows: no shuffle, and memory of one batch and a bounded store of known words per task.

    Result: the key, ids (array of int).
    """
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("value", T.ArrayType(T.IntegerType()))])
    coded = source.mapInArrow(_encoder(path or vocabulary(), _id_lists), out)
    return coded.select(F.col("key").alias(key), F.col("value").alias("ids"))


def count_tokens(documents: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """The number of tokens of each whole text: the key, tokens (int)."""
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("value", T.IntegerType())])
    counted = source.mapInArrow(_encoder(path or vocabulary(), lambda coded: pa.array([len(x) for x in coded], pa.int32())), out)
    return counted.select(F.col("key").alias(key), F.col("value").alias("tokens"))
