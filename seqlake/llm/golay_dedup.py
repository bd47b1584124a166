"""Op 5: SimHash near-duplicates found by Golay-code fuzzy hashing.

Fingerprints are 64 bits of XXH64 hashes of three-word shingles. Links hold at RADIUS or fewer differing bits. A
fingerprint is cut into three segments of 22, 21 and 21 bits. Of three differing bits at most two are outside the segment
with most of them, so two of the three segments differ in at most one bit each. The binary Golay code (23, 12) covers
every 23-bit word within three bits of one codeword. Each segment is decoded to the index of its codeword (12 bits), and
also to the indices that the segment would have with any one bit changed: one or six indices. A fingerprint is filed
under the index pairs of its own segments (three keys) and looks under all combinations of its nearby indices, so every
link meets under some key; each meeting is verified on all bits.

Only distinct fingerprints meet, under keys that are sorted in many tasks; from each bucket only the links of a spanning
forest leave, never all pairs. A key with more than HOT filed fingerprints is split into parts that each see all that look
under it. Components come from distributed star steps. A text without words has fingerprint zero; null texts are empty;
rows without an id keep a null id and count for no component's name. Repeated rows fall in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import arrow, fresh, small_batches, sole, texts, written
from seqlake.llm.components import components, local, stars

RADIUS, SHINGLE, SEED = 3, 3, 42
HOT = 20_000
#: The generator polynomial of the binary Golay code, its length and its message bits.
GENERATOR, LENGTH, MESSAGE = 0xC75, 23, 12
#: First bit and bits of each segment; pairs of segments that make keys.
SEGMENTS, PAIRS = ((0, 22), (22, 21), (43, 21)), ((0, 1), (0, 2), (1, 2))


def fingerprint(text: str) -> int:
    """Unsigned fingerprint of a text: bit set if in more than half of its shingles' hashes."""
    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)], strict=False))], np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = total * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), fp: the fingerprint as a signed long."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(got.view(np.int64))], names=["doc_id", "h", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _alone()
        return arrow(batches, work)

    small_batches(docs.sparkSession)
    return texts(docs).withColumn("h", F.xxhash64("text")).mapInArrow(run, "doc_id long, h long, fp long")


class Golay:
    """Tables for decoding: errors by syndrome, and the changes that lead to each nearby codeword."""

    def __init__(self):
        def syndrome(w: int) -> int:
            for i in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
                if w >> i & 1:
                    w ^= GENERATOR << (i - (LENGTH - MESSAGE))
            return w

        unit = [syndrome(1 << i) for i in range(LENGTH)]
        self.unit = unit
        n = 1 << (LENGTH - MESSAGE)
        error = [0] * n
        for i in range(LENGTH):
            error[unit[i]] = 1 << i
            for j in range(i):
                error[unit[i] ^ unit[j]] = 1 << i | 1 << j
                for k in range(j):
                    error[unit[i] ^ unit[j] ^ unit[k]] = 1 << i | 1 << j | 1 << k
        self.error = np.array(error, np.int64)
        self.near = {}
        for bits in {b for _, b in SEGMENTS}:
            ways = [sorted({error[s]} | {1 << i ^ error[s ^ unit[i]] for i in range(bits)}) for s in range(n)]
            most = max(map(len, ways))
            self.near[bits] = np.array([w + [-1] * (most - len(w)) for w in ways], np.int64)

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for i, u in enumerate(self.unit):
            out ^= np.where(words >> i & 1, u, 0)
        return out

    def index(self, codewords: np.ndarray) -> np.ndarray:
        return codewords >> (LENGTH - MESSAGE)


_golay: dict[str, Golay] = {}


def _alone() -> None:
    """Only this operator's tables stay in the worker. A function of the module, as nested ones get copies of its variables."""
    sole(_golay)


def golay() -> Golay:
    if not sole(_golay):
        _golay["tables"] = Golay()
    return _golay["tables"]


def filed(fp: np.ndarray) -> np.ndarray:
    """The keys that fingerprints are filed under, a column for each pair of segments."""
    g, raw, own = golay(), fp.view(np.uint64), []
    for first, bits in SEGMENTS:
        w = ((raw >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        own.append(g.index(w ^ g.error[g.syndromes(w)]))
    return np.stack([p << 24 | own[a] << 12 | own[b] for p, (a, b) in enumerate(PAIRS)], 1)


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, kind) of fingerprints: kind 0 files a row under a key, kind 1 looks it up there."""
    g = golay()
    raw = fp.view(np.uint64)
    near = []
    for first, bits in SEGMENTS:
        w = ((raw >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        s = g.syndromes(w)
        change = g.near[bits][s]
        near.append(np.where(change >= 0, g.index(w[:, None] ^ change), -1))
    own = filed(fp)
    rows, found, kinds = [np.repeat(np.arange(len(fp)), len(PAIRS))], [own.ravel()], [np.zeros(own.size, np.int8)]
    for p, (a, b) in enumerate(PAIRS):
        both = np.where((near[a][:, :, None] >= 0) & (near[b][:, None, :] >= 0), p << 24 | near[a][:, :, None] << 12 | near[b][:, None, :], -1).reshape(len(fp), -1)
        i, j = np.nonzero(both >= 0)
        rows.append(i)
        found.append(both[i, j])
        kinds.append(np.ones(len(i), np.int8))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(kinds)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        all_fp = b.column("fp").to_numpy()
        for z in range(0, len(all_fp), 4096):
            fp = all_fp[z : z + 4096]
            row, key, kind = keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind), pa.array(fp[row])], names=["key", "kind", "fp"])


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(filed(b.column("fp").to_numpy()).ravel())], names=["key"])


def _links(key: np.ndarray, kind: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Star edges of the links in whole runs of equal keys, filed fingerprints first in each run."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    run = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    held = np.add.reduceat((kind == 0).astype(np.int64), first)
    ask = np.flatnonzero((kind == 1) & (held[run] > 0))
    many = held[run[ask]]
    ends = np.cumsum(many)
    z = 0
    while z < len(ask):
        base = ends[z] - many[z]
        y = max(z + 1, int(np.searchsorted(ends, base + 2_000_000, side="right")))
        n, a = many[z:y], ask[z:y]
        left = np.repeat(a, n)
        right = np.repeat(first[run[a]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x, w = fp[left], fp[right]
        close = (np.bitwise_count((x ^ w).view(np.uint64)) <= RADIUS) & (x != w)
        if close.any():
            yield stars(x[close], w[close])
        z = y


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = [[], [], []]

    def done(parts):
        for u, v in _links(*parts):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for b in batches:
        for h, c in zip(held, ("key", "kind", "fp"), strict=True):
            h.append(b.column(c).to_numpy())
        if sum(map(len, held[0])) >= 200_000:
            parts = [np.concatenate(h) for h in held]
            cut = int(np.searchsorted(parts[0], parts[0][-1]))  # the last run may go on
            if cut:
                yield from done([p[:cut] for p in parts])
            held = [[p[cut:]] for p in parts]
    if held[0] and sum(map(len, held[0])):
        yield from done([np.concatenate(h) for h in held])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of a partition's links, both found by one worker."""
    return local(_matched(batches))


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges u, v between distinct fingerprints (fp) that connect just what RADIUS links connect."""
    spark = distinct.sparkSession
    small_batches(spark, 10_000)
    rows = distinct.mapInArrow(_keyed, "key long, kind byte, fp long")
    crowded = written(distinct.mapInArrow(_filed, "key long").groupBy("key").count().where(F.col("count") > hot).select("key", F.ceil(F.col("count") / hot).cast("int").alias("parts")))
    n = crowded.count()
    if n:
        # a part for each `hot` filed fingerprints; whoever looks under the key is sent to every part
        crowded = F.broadcast(crowded) if n <= 50_000 else crowded
        part = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("kind") == 0, F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        rows = rows.join(crowded, "key", "left").select("key", "kind", "fp", F.explode(part).alias("part")).select((F.col("part").cast("long") * (1 << 27) + F.col("key")).alias("key"), "kind", "fp")
    return rows.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(_linked, "u long, v long")


def _roots(prints: DataFrame, hot: int) -> DataFrame:
    """fp, root for every distinct fingerprint, written."""
    distinct = written(prints.select("fp").distinct())
    roots = components(links(distinct, hot), starred=True)
    return written(distinct.join(roots, distinct["fp"] == roots["u"], "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint, component_id for every row."""
    prints = written(fingerprints(docs))
    roots = _roots(prints, hot)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(roots.join(least, "root").select("fp", "component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(of, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs with one row of each component: the one of the smallest doc_id (a null id comes last)."""
    prints = written(fingerprints(docs).withColumn("key", F.coalesce("doc_id", F.lit(2**63 - 1))))
    roots = _roots(prints, hot)
    first = prints.groupBy("fp").agg(F.min(F.struct("key", "h")).alias("f")).join(roots, "fp").groupBy("root").agg(F.min("f").alias("f")).select("f.key", "f.h")
    k, h = fresh(docs, "key"), fresh(docs, "h")
    rows = docs.withColumns({k: F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), h: F.xxhash64(F.coalesce("text", F.lit("")))})
    kept = written(first.withColumnsRenamed({"key": k, "h": h}))
    again = prints.groupBy(F.col("key").alias(k), F.col("h").alias(h)).count().where("count > 1").select(k, h)
    again = written(again.join(kept, [k, h], "left_semi"))
    mine = rows.join(kept, [k, h], "left_semi")
    if again.limit(1).count():  # kept rows that the table holds several times
        mine = mine.join(again, [k, h], "left_anti").unionByName(rows.join(again, [k, h], "left_semi").dropDuplicates([k, h]))
    return mine.select(*docs.columns)
