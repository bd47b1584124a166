"""Op 1: benchmark decontamination.

Texts are read as lower-case words of letters and digits, and as shingles of five words. A document is contaminated by a
benchmark item if some window of the document, of as many words as the item, has a weighted Jaccard similarity of at
least THRESHOLD with it: shingles count as often as they occur, and an item's shingles weigh one over the number of
different item texts in the whole benchmark that hold them. Shingles of a window that the item doesn't have weigh as much
as the item's own on average. So the similarity of a document and an item doesn't depend on blocks or repeated items.

A window that reaches the threshold shares shingles with its item that weigh THRESHOLD of the item at least, so windows are
looked at only where a document has that much of it, those with most first, and verified by their exact similarity; none
is missed. The benchmark goes to the workers in blocks of BLOCK_BYTES, each with the weights of its shingles; more of it
means more passes, never a larger block.

Texts and items of fewer than five words are one shingle of all their words; such items match whole texts only. Null and
empty texts and items match nothing. Repeated rows and repeated items match each on their own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import small_batches, sole, texts, written
from seqlake.llm.word_hash import shingles, words

SHINGLE, THRESHOLD, BLOCK_BYTES = 5, 0.8, 8_000_000
FILTER_BITS = 22


def shingled(hashes: np.ndarray) -> np.ndarray:
    return shingles(hashes, SHINGLE) if len(hashes) >= SHINGLE else shingles(hashes, len(hashes)) if len(hashes) else np.zeros(0, np.uint64)


class Benchmark:
    """A block of items, with their shingles and weights."""

    def __init__(self, items: list[tuple[int, str]], shared: dict[int, int]):
        """shared: how many different item texts of the whole benchmark hold a shingle, where more than one does."""
        hashes, at = words([t for _, t in items])
        self.ids = [i for i, _ in items]
        own = [shingled(hashes[a:b]) for a, b in zip(at, at[1:], strict=False)]
        self.size = np.diff(at)
        self.count = [Counter(s.tolist()) for s in own]
        held: dict[int, list[int]] = {}
        for i, c in enumerate(self.count):
            for s in c:
                held.setdefault(s, []).append(i)
        self.held = held
        self.weight = {s: 1 / shared.get(s, 1) for s in held}
        self.known = np.array(sorted(held), np.uint64)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.known >> np.uint64(64 - FILTER_BITS)] = True
        self.total = [sum(n * self.weight[s] for s, n in c.items()) for c in self.count]

    def hits(self, s: np.ndarray) -> np.ndarray:
        """Places of shingles that the block has."""
        maybe = np.flatnonzero(self.filter[s >> np.uint64(64 - FILTER_BITS)])
        if not len(maybe):
            return maybe
        at = np.minimum(np.searchsorted(self.known, s[maybe]), len(self.known) - 1)
        return maybe[self.known[at] == s[maybe]]

    def similarity(self, window: np.ndarray, item: int) -> float:
        own, other = Counter(window.tolist()), self.count[item]
        weight, total = self.weight, self.total[item]
        both = sum(min(n, own[s]) * weight[s] for s, n in other.items() if s in own)
        foreign = sum(n for s, n in own.items() if s not in other)
        mine = sum(n * weight[s] for s, n in own.items() if s in other) + foreign * total / other.total()
        return both / (mine + total - both)

    def leaks(self, s: np.ndarray, n_words: int, hits: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window for each item that a document holds."""
        if n_words < SHINGLE:
            return [(i, 1.0, 0, n_words) for i in self.held[int(s[0])] if self.size[i] == n_words]
        places: dict[int, list[int]] = {}
        for p in hits.tolist():
            for i in self.held[int(s[p])]:
                places.setdefault(i, []).append(p)
        out = []
        for i, own in sorted(places.items()):
            size, least = int(self.size[i]), THRESHOLD * self.total[i] - 1e-9
            weights = [self.weight[int(s[p])] for p in own]
            if size < SHINGLE or sum(weights) < least:
                continue
            span = size - SHINGLE + 1  # shingles in a window
            at = np.array(own)
            last = max(0, len(s) - span)
            lo = np.arange(max(0, int(at[0]) - span + 1), min(last, int(at[-1])) + 1)  # all windows with a place
            sums = np.r_[0.0, np.cumsum(weights)]
            some = sums[np.searchsorted(at, lo + span)] - sums[np.searchsorted(at, lo)]
            best = (0.0, 0)
            for k in np.argsort(-some, kind="stable").tolist():
                if some[k] < max(least, best[0] * self.total[i] - 1e-9):  # no further window can be similar enough, or more so
                    break
                x = self.similarity(s[lo[k] : lo[k] + span], i)
                if x >= THRESHOLD and x > best[0]:
                    best = x, int(lo[k])
                if best[0] >= 1:
                    break
            if best[0]:
                out.append((i, best[0], best[1], size))
        return out


_made: dict[int, Benchmark] = {}


def _block_of(items) -> Benchmark:
    """The block in this worker process; only the last one is kept."""
    if items.key not in sole(_made):
        _made.clear()
        _made[items.key] = Benchmark(*items.value.value)
    return _made[items.key]


class _Items:
    def __init__(self, key, value):
        self.key, self.value = key, value


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different shingles of each row's text, with its block."""
    for b in batches:
        hashes, at = words(b.column("text").to_pylist())
        own = [np.unique(shingled(hashes[x:z])) for x, z in zip(at, at[1:], strict=False)]
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(np.repeat(b.column("block").to_numpy(), [len(x) for x in own]))], names=["s", "block"])


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[_Items]:
    """The benchmark in blocks of about block_bytes, each on its way to the workers."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    # equal texts are in one block
    items = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    held = items.select("text", "block").distinct().mapInArrow(_shingles, "s long, block long")
    shared = held.groupBy("s").agg(F.count("*").alias("n"), F.collect_set("block").alias("blocks")).where("n > 1")
    shared = written(shared) if blocks > 1 else shared
    for k in range(blocks):
        own = [(r["item_id"], r["text"]) for r in items.where(F.col("block") == k).orderBy("item_id", "text").collect()]
        of = {r["s"] % (1 << 64): r["n"] for r in shared.where(F.array_contains("blocks", k)).collect()}  # shingles of the block at most
        yield _Items((k, hash((tuple(own), tuple(sorted(of.items()))))), spark.sparkContext.broadcast((own, of)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: a row for each item that a document holds."""
    small_batches(docs.sparkSession)
    found = None
    for shared in _blocks(benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = _block_of(shared)
            for b in batches:
                out = _in_batch(block, b.column("doc_id").to_pylist(), b.column("text").to_pylist())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = texts(docs).mapInArrow(run, "doc_id long, item_id long, similarity double, first_word int, n_words int")
        found = part if found is None else found.unionByName(part)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold an item."""
    small_batches(docs.sparkSession)
    for shared in _blocks(benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = _block_of(shared)
            for b in batches:
                if b.num_rows:
                    leaky = {row[0] for row in _in_batch(block, list(range(b.num_rows)), [t or "" for t in b.column("text").to_pylist()])}
                    yield b.filter(pa.array([i not in leaky for i in range(b.num_rows)]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _in_batch(block: Benchmark, ids: list, own: list[str]) -> list[tuple]:
    """(id, item, similarity, first word, words) of what the texts of a batch hold."""
    if not len(block.known) or not own:
        return []
    hashes, at = words(own)
    out = []
    s = shingles(hashes, SHINGLE)
    places = block.hits(s) if len(s) else np.zeros(0, np.int64)
    doc = np.searchsorted(at, places, side="right") - 1
    good = places + SHINGLE <= at[doc + 1]  # not over the end of a document
    places, doc = places[good], doc[good]
    for d in np.unique(doc).tolist():
        a, z = int(at[d]), int(at[d + 1])
        for i, x, first, n in block.leaks(s[a : z - SHINGLE + 1], z - a, places[doc == d] - a):
            out.append((ids[d], block.ids[i], x, first, n))
    for d in np.flatnonzero((np.diff(at) < SHINGLE) & (np.diff(at) > 0)).tolist():
        one = shingled(hashes[at[d] : at[d + 1]])
        if int(one[0]) in block.held:
            for i, x, first, n in block.leaks(one, int(at[d + 1] - at[d]), np.zeros(1, int)):
                out.append((ids[d], block.ids[i], x, first, n))
    return out
