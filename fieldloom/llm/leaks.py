"""Passages of evaluation items in a training corpus, by spaced seeds.

Fixed masks over a window of words select some positions and ignore the others; windows that agree
on the selected words have the same hash even if an ignored word was changed. Hashes of the items
and of the corpus are joined, and each hit is verified word by word along its diagonal, forwards
and backwards, with or without substitutions. The masks find every exact run; altered passages are
sought by three words in a row, which no allowed pattern of substitutions can avoid.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.plans.ordered import with_running_total
from fieldloom.plans.scale import shared_path, spread, stored
from fieldloom.sources.parquet_blocks import file_system

#: Words of an item that must stand in a row.
LEAST_WORDS = 12
# The selected positions of each mask; every mask fits a window of 12 words.
MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 3, 4, 7, 9, 10, 11), (0, 2, 3, 5, 6, 8, 10, 11), (0, 1, 2, 5, 7, 8, 9, 11))
#: An overlap of n >= 12 words with s <= n/4 substitutions has s + 1 runs of n - s >= 3s equal words, so one of at least 3 words: all are found.
RUN: tuple[tuple[int, ...], ...] = ((0, 1, 2),)
#: Hits, and words along diagonals, that are held at once.
CHUNK = 1_000_000
#: Characters of items up to which their seeds are sent to every task (about 48 MB); more are joined by hash with the corpus' seeds.
HELD_CHARS = 2_000_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the NFC text, in lower case; none for null."""
    if not text:
        return []
    text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    # only these two depend on where a word ends when they are written small
    if "\u0130" in text or "\u03a3" in text:
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


_MIX = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 for i in range(LEAST_WORDS)], dtype=np.uint64)


def window_hashes(codes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """One hash for each window of the mask's span."""
    n = len(codes) - mask[-1]
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, at in enumerate(mask):
            out += (codes[at:at + n] ^ (codes[at:at + n] >> np.uint64(29))) * _MIX[k]
        out ^= out >> np.uint64(31)
    return out


class Coder:
    """Words to 64-bit codes, remembered up to a bound."""

    def __init__(self, memory: int = 500_000) -> None:
        self.known: dict[str, int] = {}
        self.memory = memory

    def codes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.memory:
            known.clear()
        found = list(map(known.get, words))
        if None in found:
            for i, c in enumerate(found):
                if c is None:
                    found[i] = known[words[i]] = xxhash.xxh3_64_intdigest(words[i].encode("utf-8", "surrogatepass"))
        return np.array(found, dtype=np.uint64)


@dataclass
class Items:
    """The seeds of some items: per mask, sorted hashes with the item and the position of each."""

    ids: list[int]
    words: list[list[str]]
    masks: tuple[tuple[int, ...], ...] = MASKS

    def __post_init__(self) -> None:
        coder = Coder()
        codes = [coder.codes(w) for w in self.words]
        self.flat = np.concatenate(codes) if codes else np.empty(0, dtype=np.uint64)
        self.sizes = np.array([len(c) for c in codes], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.seeds = []
        for mask in self.masks:
            hashes = [window_hashes(c, mask) for c in codes]
            flat = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
            item = np.repeat(np.arange(len(codes)), [len(h) for h in hashes])
            at = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, dtype=np.int64)
            order = np.argsort(flat, kind="stable")
            self.seeds.append((flat[order], item[order], at[order]))

    def hits(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Items and shifts (document position minus item position) of all seed hits, about ``CHUNK`` at once."""
        for mask, (flat, item, at) in zip(self.masks, self.seeds):
            hashes = window_hashes(codes, mask)
            if not len(hashes) or not len(flat):
                continue
            low = np.searchsorted(flat, hashes, side="left")
            hit = np.flatnonzero(flat[np.minimum(low, len(flat) - 1)] == hashes)
            if not len(hit):
                continue
            first, last = low[hit], np.searchsorted(flat, hashes[hit], side="right")
            every = np.cumsum(last - first)
            cuts = np.unique([0, *np.searchsorted(every, np.arange(CHUNK, every[-1], CHUNK)), len(hit)])
            for a, b in zip(cuts[:-1], cuts[1:]):
                times = (last - first)[a:b]
                seed = np.repeat(first[a:b], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                yield item[seed], np.repeat(hit[a:b], times) - at[seed]

    def touched(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which of the documents, whose codes stand one after another, may have a seed hit; one with a hit is never left out."""
        of = np.repeat(np.arange(len(sizes)), sizes)
        out = np.zeros(len(sizes), dtype=bool)
        for mask, (flat, _, _) in zip(self.masks, self.seeds):
            hashes = window_hashes(codes, mask)
            if len(hashes) and len(flat):
                out[of[:len(hashes)][flat[np.minimum(np.searchsorted(flat, hashes), len(flat) - 1)] == hashes]] = True
        return out

    def diagonals(self, codes: np.ndarray) -> set[tuple[int, int]]:
        """(item, document position minus item position) of all seed hits."""
        out: set[tuple[int, int]] = set()
        for item, shift in self.hits(codes):
            out.update(zip(item.tolist(), shift.tolist()))
        return out

    def alike(self, codes: np.ndarray) -> tuple[list[tuple[int, int]], dict[int, int]]:
        """The diagonals that hold an overlap of enough words with at most one substitution in four; of their items, the longest equal run."""
        fitting: list[tuple[int, int]] = []
        longest: dict[int, int] = {}
        step = 2 * len(codes) + 2 * int(self.sizes.max(initial=0)) + 1
        runs: list[tuple[np.ndarray, np.ndarray]] = []
        for item, shift in self.hits(codes):
            key = np.unique(item * step + shift + step // 2)
            item, shift = key // step, key % step - step // 2
            begin = np.maximum(0, -shift)
            n = np.minimum(self.sizes[item], len(codes) - shift) - begin
            order = np.argsort(n, kind="stable")
            item, shift, begin, n = item[order], shift[order], begin[order], n[order]
            at = 0
            while at < len(n):
                end = at + max(1, min(len(n) - at, CHUNK // int(n[at])))
                end = at + max(1, min(end - at, CHUNK // int(n[end - 1])))
                cut = slice(at, end)
                i = np.arange(n[end - 1])
                inside = i < n[cut, None]
                along = np.where(inside, begin[cut, None] + i, 0)
                equal = inside & (self.flat[self.starts[item[cut], None] + along] == codes[np.where(inside, along + shift[cut, None], 0)])
                score = np.zeros((end - at, len(i) + 1), dtype=np.int64)
                np.cumsum(np.where(equal, 1, np.where(inside, -3, -4 * len(i))), axis=1, out=score[:, 1:])
                fits = (score[:, LEAST_WORDS:] >= np.minimum.accumulate(score[:, :-LEAST_WORDS], axis=1)).any(axis=1)
                fitting += zip(item[cut][fits].tolist(), shift[cut][fits].tolist())
                runs.append((item[cut], (i - np.maximum.accumulate(np.where(equal, -1, i), axis=1)).max(axis=1)))
                at = end
        found = {k for k, _ in fitting}
        if found:
            for item, run in runs:
                held = np.isin(item, list(found))
                for k, r in zip(item[held].tolist(), run[held].tolist()):
                    longest[k] = max(r, longest.get(k, 0))
        return sorted(set(fitting)), longest


def overlap(doc: list[str], item: list[str], shift: int, penalty: float = 1.0) -> tuple[int, int, int, int, int]:
    """(longest exact run, words of the best overlap, its substitutions, its start in the document, in the item) on one diagonal.

    The best overlap has the greatest sum of 1 for an equal word and ``-penalty`` for a substitution.
    """
    start = max(0, -shift)
    stop = min(len(item), len(doc) - shift)
    exact = run = 0
    best = score = 0.0
    begin, found = start, (start, start)
    for i in range(start, stop):
        if doc[i + shift] == item[i]:
            run += 1
            exact = max(exact, run)
            score += 1.0
        else:
            run = 0
            score -= penalty
        if score <= 0:
            score, begin = 0.0, i + 1
        elif score > best:
            best, found = score, (begin, i + 1)
    a, b = found
    changed = sum(doc[i + shift] != item[i] for i in range(a, b))
    return exact, b - a, changed, a + shift, a


def close_overlap(doc: list[str], item: list[str], shift: int) -> tuple[int, int, int, int, int]:
    """``overlap``, or where that one is too short or too much changed, the one of at least 12 words with the greatest sum of 1 for an equal word and -3 for a substitution."""
    held = overlap(doc, item, shift)
    if held[1] >= LEAST_WORDS and 4 * held[2] <= held[1]:
        return held
    start, stop = max(0, -shift), min(len(item), len(doc) - shift)
    sums = [0]
    for i in range(start, stop):
        sums.append(sums[-1] + (1 if doc[i + shift] == item[i] else -3))
    best, low, found = -1, 0, None
    for end in range(LEAST_WORDS, len(sums)):
        if sums[end - LEAST_WORDS] < sums[low]:
            low = end - LEAST_WORDS
        if sums[end] - sums[low] > best:
            best, found = sums[end] - sums[low], (low, end)
    if found is None:
        return held
    n = found[1] - found[0]
    return held[0], n, (n - best) // 4, start + found[0] + shift, start + found[0]


def held_items(items: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS, held_chars: int = HELD_CHARS) -> Items | None:
    """The items with enough words, if all texts together are within the bound; else None."""
    texts = _item_texts(items)
    if (texts.agg(F.sum(F.length("item_text"))).first()[0] or 0) > held_chars:
        return None
    found = [(r.item_id, words_of(r.item_text)) for r in texts.collect()]
    found = [(i, w) for i, w in found if len(w) >= LEAST_WORDS]
    return Items([i for i, _ in found], [w for _, w in found], masks)


def leaked_passages(documents: DataFrame, items: DataFrame, held_chars: int = HELD_CHARS) -> DataFrame:
    """doc_id, item_id, exact_words, overlap_words, substitutions, doc_start, item_start.

    A row for each document and item that share an overlap of at least 12 words with at most one
    substitution in four, all of them (recall 1 by ``RUN``; words put in or left out end an overlap):
    ``exact_words`` is the longest run of at least 3 equal words, the others describe the best
    overlap (positions count words from 0). Whole texts are read; null, empty and
    short texts have no rows; repeated documents have the rows of each. An item_id with several texts
    has a row for each. Items within ``held_chars`` are joined in the tasks that read the corpus,
    without a shuffle; of more, each such task reads them in blocks, with the same rows.
    """
    return _passages(documents, items, held_chars, RUN)


_COLUMNS = ["doc_id", "item_id", "exact_words", "overlap_words", "substitutions", "doc_start", "item_start"]
_SCHEMA = "doc_id long, item_id int, exact_words int, overlap_words int, substitutions int, doc_start int, item_start int"


def _corpus(documents: DataFrame) -> DataFrame:
    return spread(documents.selectExpr("cast(doc_id as bigint) doc_id", "text").where("doc_id is not null and text is not null"))


def _best(group: Items, doc: list[str], diagonals: Iterable[tuple[int, int]], runs: dict[int, int]) -> dict[int, tuple[int, ...]]:
    """Of each item the best overlap on its diagonals with a document."""
    best: dict[int, tuple[int, ...]] = {}
    for k, shift in diagonals:
        exact, n, changed, at, begin = close_overlap(doc, group.words[k], shift)
        exact = max(exact, runs.get(k, 0))
        held = best.get(k)
        longest = max(exact, held[0]) if held else exact
        if held is None or n - 4 * changed > held[1] - 4 * held[2]:
            held = (longest, n, changed, at, begin)
        best[k] = (longest, *held[1:])
    return {k: v for k, v in best.items() if v[0] >= LEAST_WORDS or (v[1] >= LEAST_WORDS and 4 * v[2] <= v[1])}


def _passages(documents: DataFrame, items: DataFrame, held_chars: int, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """The passages that share a seed of the masks; all with ``RUN``, and with ``MASKS`` only the exact ones are sure to be there."""
    group = held_items(items, masks, held_chars)
    if group is None:
        return _joined_passages(documents, items) if masks == MASKS else _blocked_passages(documents, items, held_chars)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder()
        for b in batches:
            yield _matches(b, group, coder)

    return _corpus(documents).mapInPandas(run, _SCHEMA)


def _matches(batch: pd.DataFrame, group: Items, coder: Coder) -> pd.DataFrame:
    out = []
    docs = [(doc_id, doc) for doc_id, doc in zip(batch["doc_id"], map(words_of, batch["text"])) if len(doc) >= LEAST_WORDS]
    sizes = np.array([len(doc) for _, doc in docs], dtype=np.int64)
    every = coder.codes([w for _, doc in docs for w in doc])
    ends = np.cumsum(sizes)
    # the windows of all documents are looked up at once, then only documents with a hit by themselves
    for k in np.flatnonzero(group.touched(every, sizes)):
        doc_id, doc = docs[k]
        codes = every[ends[k] - sizes[k]:ends[k]]
        fitting, runs = group.alike(codes) if group.masks == RUN else (sorted(group.diagonals(codes)), {})
        out += [(doc_id, group.ids[i], *v) for i, v in _best(group, doc, fitting, runs).items()]
    return pd.DataFrame(out, columns=_COLUMNS)


def _item_texts(items: DataFrame) -> DataFrame:
    return items.selectExpr("cast(item_id as int) as item_id", "item_text").where("item_id is not null and item_text is not null").distinct()


def _blocked_passages(documents: DataFrame, items: DataFrame, held_chars: int) -> DataFrame:
    """The altered passages of items too many to be held: each task meets blocks of them, read from the shared folder one after another.

    Three words in a row are too common for a join; so the driver and a task hold no more than one block.
    """
    texts = _item_texts(items).select(F.xxhash64("item_id", "item_text").alias("name"), F.lit(0).alias("all"), "item_id", "item_text", F.length("item_text").alias("size"))
    placed = with_running_total(texts, ["all"], ["name", "item_id"], "size", "before").withColumn("block", F.floor(F.col("before") / held_chars))
    folder = shared_path(items.sparkSession, f"items-{uuid.uuid4().hex}")

    def store(pdf: pd.DataFrame) -> pd.DataFrame:
        words = [(int(i), words_of(t)) for i, t in zip(pdf["item_id"], pdf["item_text"])]
        words = [(i, w) for i, w in words if len(w) >= LEAST_WORDS]
        system, at = file_system(f"{folder}/{int(pdf['block'].iloc[0])}")
        system.create_dir(at.rpartition("/")[0], recursive=True)
        with system.open_output_stream(at) as f:
            f.write(pickle.dumps(([i for i, _ in words], [w for _, w in words])))
        return pd.DataFrame({"path": [f"{folder}/{int(pdf['block'].iloc[0])}"]})

    paths = [r.path for r in placed.select("block", "item_id", "item_text").groupBy("block").applyInPandas(store, "path string").collect()]  # one for each block

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder()
        for b in batches:
            for path in paths:
                system, at = file_system(path)
                with system.open_input_file(at) as f:
                    yield _matches(b, Items(*pickle.loads(f.read()), RUN), coder)

    return _corpus(documents).mapInPandas(run, _SCHEMA)


def _seeds(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, mask, h, at: a row for each window of each mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder()
        for b in batches:
            for name, t in zip(b[key], b[text]):
                words = words_of(t)
                if len(words) < LEAST_WORDS:
                    continue
                codes = coder.codes(words)
                for m, mask in enumerate(MASKS):
                    h = window_hashes(codes, mask).view(np.int64)
                    yield pd.DataFrame({key: name, "mask": m, "h": h, "at": np.arange(len(h))})

    return texts.mapInPandas(run, f"{key} long, mask int, h long, at int")


def _joined_passages(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The exact passages of items too many to be held, by a join of both sides' hashes.

    A seed of many documents and items is split by the skew join. The hits of a document and an item
    come down to their different diagonals, and only such pairs meet their texts.
    """
    texts = stored(_item_texts(items).withColumn("item_key", F.monotonically_increasing_id()))
    corpus = _corpus(documents).select(F.xxhash64("doc_id", "text").alias("doc_key"), "doc_id", "text")
    left = _seeds(corpus, "doc_key", "text").withColumnRenamed("at", "pos")
    right = _seeds(spread(texts.select("item_key", "item_text")), "item_key", "item_text")
    pairs = left.join(right, ["mask", "h"]).select("doc_key", "item_key", (F.col("pos") - F.col("at")).alias("shift")).distinct().groupBy("doc_key", "item_key").agg(F.collect_list("shift").alias("shifts"))
    met = pairs.join(texts, "item_key").join(corpus, "doc_key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text, item_id, item_text, shifts in zip(b["doc_id"], b["text"], b["item_id"], b["item_text"], b["shifts"]):
                group = Items([int(item_id)], [words_of(item_text)])
                out += [(doc_id, group.ids[k], *v) for k, v in _best(group, words_of(text), [(0, int(s)) for s in sorted(shifts)], {}).items()]
            yield pd.DataFrame(out, columns=_COLUMNS)

    return met.select("doc_id", "text", "item_id", "item_text", "shifts").mapInPandas(run, _SCHEMA)


def leaked_items(documents: DataFrame, items: DataFrame, held_chars: int = HELD_CHARS) -> DataFrame:
    """doc_id, item_id of the documents that hold at least 12 consecutive words of an item, in order.

    Items within ``held_chars`` are joined in the tasks that read the corpus, more by a hash join of both sides' seeds.
    """
    return _passages(documents, items, held_chars, MASKS).where(f"exact_words >= {LEAST_WORDS}").select("doc_id", "item_id").distinct()
