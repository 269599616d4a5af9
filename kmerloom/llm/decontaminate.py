"""Benchmark decontamination: CGK walks, bit-sampling LSH over item-sized windows, exact check.

A CGK walk reads a word sequence by a pointer that, step by step, stays or moves as a random function
of step and word tells; sequences at a small edit distance give walks that differ in few steps, so
edit distance becomes Hamming distance. Sampling a few steps of the walk as a key is a bit-sampling
LSH of it; enough walks and samples reach the wanted recall. A pair that meets under a key is
accepted by its exact edit distance only.

Windows that cannot hold an item are not embedded: within d edits of an item of m words at least
m - q + 1 - q * d of its word q-grams are left. That bound loses nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.tables import whole

WORD = re.compile(r"\w+")
#: Words of a gram; items below LEAST words are ignored, items below NEAR words must match exactly.
Q, LEAST, NEAR = 3, 5, 8
#: Independent walks, samples of a walk, steps in a sample.
WALKS, SAMPLES, STEPS = 64, 4, 2
#: Text bytes of items that one pass over the documents holds in memory.
BLOCK_BYTES = 2 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def edits(m: int, similarity: float) -> int:
    """Edits allowed for an item of m words."""
    return int(m * (1 - similarity) + 1e-9) if m >= NEAR else 0


def grams_left(m: int, d: int) -> int:
    return max(1, m - Q + 1 - Q * d)


def distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the region, and where the first such stretch ends."""
    columns = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, dtype=np.int64)
    for i, word in enumerate(item.tolist(), 1):
        fresh = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate(([i], fresh)) - columns) + columns
    end = int(row.argmin())
    return int(row[end]), end


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Index:
    """What one block of items needs in every task; its size follows the block's, which is bounded."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, seed: int = 7):
        self.similarity = similarity
        named: dict[tuple[str, ...], int | None] = {}
        for item_id, text in items:
            words = tuple(words_of(text or ""))
            if len(words) >= LEAST:
                held = named.get(words, item_id)
                named[words] = item_id if held is None else held if item_id is None else min(held, item_id)
        self.ids = list(named.values())
        self.vocabulary: dict[str, int] = {}
        for words in named:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.items = [np.array([self.vocabulary[w] for w in words], dtype=np.uint64) for words in named]
        lengths = sorted({len(i) for i in self.items})
        own = [self.grams(i) for i in self.items]
        self.own_grams = [set(g.tolist()) for g in own]
        grams = np.unique(np.concatenate(own)) if own else np.empty(0, np.uint64)
        self.bits = max(16, int(len(grams) * 64).bit_length())
        # which classes a gram occurs in, one bit each (classes share bits beyond 32)
        self.seen = np.zeros(1 << self.bits, dtype=np.uint32)
        # classes of similar length share windows: lengths from low to 1.15 * low
        self.classes = []
        while lengths:
            low = lengths[0]
            own = [x for x in lengths if x <= low * 1.15]
            lengths = lengths[len(own) :]
            one = self._class(low, own[-1], own, np.random.default_rng([seed, low]))
            one["bit"] = np.uint32(1 << len(self.classes) % 32)
            self.classes.append(one)
            for item in self.items:
                if low <= len(item) <= own[-1]:
                    self.seen[(self.grams(item) >> np.uint64(64 - self.bits)).astype(np.int64)] |= one["bit"]

    def grams(self, ids: np.ndarray) -> np.ndarray:
        n = max(0, len(ids) - Q + 1)
        out = np.zeros(n, dtype=np.uint64)
        for j in range(Q):
            out = _mixed(out * _MIX + ids[j : j + n] + np.uint64(1))
        return out

    def _class(self, low: int, high: int, lengths: list[int], rng: np.random.Generator) -> dict:
        # the pointer moves on every other step: these steps stay inside the shortest item on average
        steps = max(STEPS, int(1.8 * low))
        one = {
            "low": low, "high": high, "steps": steps, "stride": max(1, low // 8),
            "need": min(grams_left(m, edits(m, self.similarity)) for m in lengths),
            "span": max(m + edits(m, self.similarity) for m in lengths) - Q + 1,
            "draw": rng.integers(1, 1 << 63, size=(WALKS, steps), dtype=np.uint64) | np.uint64(1),
            "samples": np.sort(rng.integers(0, steps, size=(WALKS, SAMPLES, STEPS)), axis=2),
        }
        own = [i for i, item in enumerate(self.items) if len(item) in set(lengths)]
        padded = np.zeros((len(own), high), dtype=np.uint64)
        for row, i in enumerate(own):
            padded[row, : len(self.items[i])] = self.items[i]
        keys = self._keys(one, padded)
        order = np.argsort(keys.ravel(), kind="stable")
        one["keys"] = keys.ravel()[order]
        one["owners"] = np.tile(np.array(own, dtype=np.int64), keys.shape[0])[order]
        return one

    @staticmethod
    def _keys(one: dict, windows: np.ndarray) -> np.ndarray:
        """A key for each walk and sample (rows) of each window (columns)."""
        n, width = windows.shape
        flat = np.concatenate((windows, np.zeros((n, 1), dtype=np.uint64)), axis=1)
        rows, out = np.arange(n), []
        for walk in range(WALKS):
            at = np.zeros(n, dtype=np.int64)
            path = np.empty((one["steps"], n), dtype=np.uint64)
            for step in range(one["steps"]):
                path[step] = word = flat[rows, at]
                move = ((word + np.uint64(1)) * one["draw"][walk, step]) >> np.uint64(63)
                at = np.minimum(at + move.astype(np.int64), width)
            for sample in range(SAMPLES):
                key = np.full(n, walk * SAMPLES + sample + 1, dtype=np.uint64)
                for step in one["samples"][walk, sample]:
                    key = _mixed(key * _MIX + path[step])
                out.append(key)
        return np.stack(out)

    def search(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, first word, words, distance) in a stream of word numbers; bounds: where documents end."""
        grams = self.grams(ids)
        full = np.minimum.reduce([ids[j : j + len(grams)] > 0 for j in range(Q)]) if len(grams) else np.empty(0, bool)
        marks = np.where(full, self.seen[(grams >> np.uint64(64 - self.bits)).astype(np.int64)], np.uint32(0))
        if not marks.any():
            return
        starts = np.arange(len(grams))
        met = [np.empty(0, dtype=np.int64)]
        for one in self.classes:
            hit = (marks & one["bit"]) > 0
            total = np.concatenate(([0], np.cumsum(hit)))
            if total[-1] < one["need"]:
                continue
            ends = np.minimum(starts + one["span"], len(grams))
            able = np.flatnonzero((total[ends] - total[:-1] >= one["need"]) & (starts % one["stride"] == 0))
            # also the window that starts where the first of a row of grams was met
            first = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
            able = np.union1d(able, first[total[np.minimum(first + one["span"], len(grams))] - total[first] >= one["need"]])
            padded = np.concatenate((ids, np.zeros(one["high"], dtype=np.uint64)))
            for at in range(0, len(able), 8192):
                own = able[at : at + 8192]
                keys = self._keys(one, padded[own[:, None] + np.arange(one["high"])])
                left, right = np.searchsorted(one["keys"], keys, "left"), np.searchsorted(one["keys"], keys, "right")
                row, column = np.nonzero(right > left)
                low, many = left[row, column], (right - left)[row, column]
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                met.append(np.unique((one["owners"][np.repeat(low, many) + nth] << 32) | np.repeat(own[column], many)))
        pairs = np.unique(np.concatenate(met))
        yield from self._checked(ids, grams, bounds, pairs >> 32, pairs & 0xFFFFFFFF)

    def _checked(self, ids, grams, bounds, items, starts) -> Iterator[tuple[int, int, int, int, int]]:
        """The pairs of item and window start whose exact distance is small enough."""
        docs = np.searchsorted(bounds, starts, "right")
        halves = np.maximum(1, np.array([len(i) for i in self.items], dtype=np.int64)[items] // 2)
        # windows of one neighbourhood ask about one region
        asked = np.unique(np.stack((items, docs, starts // halves), axis=1), axis=0)
        told = set()
        for item, doc, place in asked.tolist():
            words = self.items[item]
            m = len(words)
            d = edits(m, self.similarity)
            begin, end = int(bounds[doc - 1]) if doc else 0, int(bounds[doc])
            start = place * max(1, m // 2)
            low, high = max(begin, start - m), min(end, start + 2 * m + d)
            if sum(map(self.own_grams[item].__contains__, grams[low : high - Q + 1].tolist())) < grams_left(m, d):
                continue
            cost, stop = distance(words, ids[low:high])
            if cost > d:
                continue
            back = distance_anchored(words[::-1], ids[low : low + stop][::-1])
            first = low + stop - back - begin
            if (item, doc, first) not in told:
                told.add((item, doc, first))
                yield doc, item, first, back, cost


def distance_anchored(item: np.ndarray, region: np.ndarray) -> int:
    """How many leading words of the region are nearest to the whole item."""
    columns = np.arange(len(region) + 1)
    row = columns.astype(np.int64)
    for i, word in enumerate(item.tolist(), 1):
        fresh = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate(([i], fresh)) - columns) + columns
    return int(row.argmin())


def _search(batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
    index: Index = held.value
    names = ["doc_id", "item_id", "first_word", "n_words", "distance"]

    def found(ids: list[np.ndarray], docs: list) -> pd.DataFrame | None:
        bounds = np.cumsum([len(i) for i in ids])
        rows = [(docs[d], index.ids[i], f, n, c) for d, i, f, n, c in index.search(np.concatenate(ids), bounds)]
        if not rows:
            return None
        out = pd.DataFrame(rows, columns=names)
        for name in ("doc_id", "item_id"):
            out[name] = pd.array([None if pd.isna(x) else int(x) for x in out[name].astype(object)], dtype="Int64")
        return out

    for texts in batches:
        ids, docs, size = [], [], 0
        for doc, text in zip(texts["doc_id"], texts["text"], strict=True):
            words = words_of(text)
            ids.append(np.fromiter(map(index.vocabulary.get, words, repeat(0)), dtype=np.uint64, count=len(words)))
            docs.append(doc)
            size += len(words)
            if size > 1 << 20:
                out = found(ids, docs)
                if out is not None:
                    yield out
                ids, docs, size = [], [], 0
        if ids:
            out = found(ids, docs)
            if out is not None:
                yield out


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> ``(doc_id, item_id, first_word, n_words, distance)``.

    One row for each stretch of a document whose words are within ``(1 - similarity) * m`` word edits of an
    item of m words (case and punctuation do not count). Items below 5 words are ignored, items below 8
    words match exactly; items of equal words are one item with the smallest item_id. Null and empty
    texts match nothing, null doc_ids are kept, repeated rows give repeated rows, other columns are not
    looked at. Items are held in blocks of bounded size, one pass over the documents for each block.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length(whole()))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    kept = benchmark.select("item_id", whole("text").alias("text")).where(F.length("text") > 0)
    texts = docs.select("doc_id", whole("text").alias("text"))
    out = None
    for b in range(blocks):
        block = kept.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b) if blocks > 1 else kept
        index = Index([(r["item_id"], r["text"]) for r in block.toLocalIterator()], similarity)
        held = spark.sparkContext.broadcast(index)
        part = texts.mapInPandas(lambda it, held=held: _search(it, held), "doc_id long, item_id long, first_word long, n_words long, distance long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The documents without a leak, columns as they were; rows without doc_id are judged by their text alone."""
    named = docs.select(F.struct(*docs.columns).alias("doc"), "text", F.xxhash64(F.col("doc_id"), whole("text")).alias("row"))
    found = leaks(named.select(F.col("row").alias("doc_id"), "text"), benchmark, similarity).select(F.col("doc_id").alias("row")).distinct()
    return named.join(found, "row", "left_anti").select("doc.*")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)
