"""Byte-level byte-pair encoding of whole corpora with the vocabulary of a public tokenizer.

A short word is merged on a contiguous array of part boundaries and the ranks of adjacent pairs: the
least rank is looked for by a scan, its boundary deleted, and the two neighbouring ranks refreshed.
The scan is quadratic in a word's length, so a long word takes a heap over a linked list instead,
which gives the same merges.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fieldloom.plans.scale import spread

#: Where the vocabulary files are; a parameter of every function that reads one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary's tokenizer cuts a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes up to which a word is merged by scanning.
SHORT_WORD = 96
#: Words that a worker remembers.
MEMORY = 400_000
_NO_RANK = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id from a file of base64 tokens and ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word by scanning an array of boundaries and ranks."""
    get = ranks.get
    bounds = list(range(len(word) + 1))
    pair = [get(word[i:i + 2], _NO_RANK) for i in range(len(word) - 1)]
    while pair:
        least = min(pair)
        if least == _NO_RANK:
            break
        i = pair.index(least)
        del bounds[i + 1]
        del pair[i]
        if i < len(pair):
            pair[i] = get(word[bounds[i]:bounds[i + 2]], _NO_RANK)
        if i:
            pair[i - 1] = get(word[bounds[i - 1]:bounds[i + 1]], _NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges by a heap of (rank, start) over linked parts."""
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\x01") * n
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            rank = ranks.get(word[i:end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[i] != middle or end[j] != stop:
            continue  # one of the parts has changed since
        end[i], after[i], alive[j] = stop, after[j], 0
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i:end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes texts; words met before are remembered, up to a bound."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN, memory: int = MEMORY) -> None:
        self.ranks = read_ranks(path)
        self.words = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.memory = memory

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        ids = (whole,) if whole is not None else tuple((merge_short if len(raw) <= SHORT_WORD else merge_long)(raw, self.ranks))
        if len(word) <= SHORT_WORD:
            if len(self.known) >= self.memory:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text without special tokens; nothing for null and empty texts."""
        if not text:
            return []
        out: list[int] = []
        known, put = self.known.get, out.extend
        for w in self.words(text):
            ids = known(w)
            put(ids if ids is not None else self.word(w))
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)


def encode_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (array of int): every row of ``documents`` once, without a shuffle.

    Null and empty texts have an empty array; text that looks like a special token is ordinary text.
    Rows that repeat are encoded each; other columns are ignored. The vocabulary file must be at the
    same path on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for b in batches:
            ids = [bpe.encode(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

    return spread(documents.selectExpr("cast(doc_id as bigint) doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: list[int], ranks: dict[bytes, int]) -> bytes:
    tokens = {i: t for t, i in ranks.items()}
    return b"".join(tokens[i] for i in ids)


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """source, n_documents, n_tokens: tokens of each source, summed before the shuffle."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for b in batches:
            counts = [len(bpe.encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["source", "n"])

    return spread(documents.select("source", "text")).mapInArrow(run, "source string, n long").groupBy("source").agg(F.count("n").alias("n_documents"), F.sum("n").alias("n_tokens"))
