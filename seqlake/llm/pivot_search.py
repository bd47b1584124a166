"""Op 10: exact top-k inner products through a pivot-distance index.

All vectors get one more component so that they have the same length, and queries a zero there; then the larger an inner
product, the smaller the distance. Pivots come from a bounded sample. Every vector is keyed by its nearest pivot and its distance to it; rings of
distances around a pivot (and, where one ring holds many vectors, parts of it) are the blocks of the index. A query first
searches the block it falls in, which gives a score that its k-th best can't be under. Then the annuli around each pivot
are widened as long as the triangle inequality lets a ring hold a vector that reaches this score; rings beyond are left
out, and with them nothing that belongs in the result. Blocks are searched with one matrix product for a batch of queries.

Vectors that are null or hold a null, a NaN or an infinity, or have no id, take no part. Shorter vectors count as filled with zeros.
Repeated ids are rows of their own; a query leaves out every row that has its own id. Ties go to the smaller id. With
fewer than k candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import written

#: Vectors that pivots and rings are chosen from; rows in a block of the index; pivots.
SAMPLE, BLOCK_ROWS, PIVOTS = 2048, 1024, 16


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec: array of long with floor(64 x) of each component, of those vectors that take part."""
    sound = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * 64)).alias("vec"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as integers, filled with zeros."""
    out = np.zeros((len(col), dim), np.int64)
    flat, offsets = col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())
    if len(flat) == len(col) * dim:
        return flat.reshape(len(col), dim).astype(np.int64)
    out[np.arange(dim)[None, :] < offsets[:, None]] = flat
    return out


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots by farthest-first choice and a few rounds of averaging."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    pivots = sample[chosen]
    for _ in range(5):
        own = _distances(sample, pivots).argmin(1)
        pivots = np.array([sample[own == p].mean(0) if (own == p).any() else pivots[p] for p in range(len(pivots))])
    return pivots


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def _lifted(vec: np.ndarray, top: float) -> np.ndarray:
    """The vectors with the component that makes their squared length top."""
    v = vec.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(0, top - (v * v).sum(1)))[:, None]])


def _products(index: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products; in doubles where these are exact."""
    if float(np.abs(index).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, index.shape[1]) < 2**53:
        return (queries.astype(np.float64) @ index.T.astype(np.float64)).astype(np.int64)
    return queries @ index.T


def _search(rows: DataFrame, dim: int, k: int) -> DataFrame:
    """rows (block, kind 0: index, 1: query, id, vec binary, least): the k best of a block for each of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, parts, index = None, [], [], None
        for b in batches:
            blocks, kinds = b.column("block").to_numpy(), b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1), b.num_rows]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                part = b.slice(x, y - x)
                vec = np.frombuffer(b"".join(part.column("vec").to_pylist()), np.int64).reshape(y - x, dim)
                own = part.column("id").to_numpy()
                if blocks[x] != block:
                    block, ids, parts, index = blocks[x], [], [], None
                if kinds[x] == 0:
                    ids.append(own)
                    parts.append(vec)
                    continue
                if index is None:
                    if not parts:
                        continue
                    index, names = np.vstack(parts), np.concatenate(ids)
                    order = np.argsort(names, kind="stable")
                    index, names = index[order], names[order]
                least = part.column("least").to_numpy()
                for z in range(0, y - x, 1024):
                    q, of, floor = vec[z : z + 1024], own[z : z + 1024], least[z : z + 1024]
                    score = _products(index, q)
                    fits = (score >= floor[:, None]) & (names[None, :] != of[:, None])
                    many = fits.sum(1) > k
                    out = []
                    if (~many).any():
                        i, j = np.nonzero(fits & ~many[:, None])
                        out.append((of[i], names[j], score[i, j]))
                    for i in np.flatnonzero(many):
                        j = np.flatnonzero(fits[i])
                        j = j[np.lexsort((names[j], -score[i, j]))[:k]]
                        out.append((np.full(len(j), of[i]), names[j], score[i, j]))
                    got = [np.concatenate(c) for c in zip(*out, strict=True)]
                    if len(got[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], names=["query_id", "vec_id", "score"])

    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows where is_query holds, the k others of highest inner product."""
    spark = rows.sparkSession
    sound = whole_vectors(rows, id_col, vec_col)
    queries = whole_vectors(rows.where(F.coalesce(is_query, F.lit(False))), id_col, vec_col)
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, dim, top = sound.agg(F.count("*"), F.max(F.size("vec")), F.max(norm)).first()
    if not n:
        return none
    dim = max(1, dim)
    head = sound.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()  # a bounded sample
    sample = np.zeros((len(head), dim))
    for i, v in enumerate(head["vec"]):
        sample[i, : len(v)] = v
    sample = _lifted(sample, top)
    centre = _pivots(sample, pivots)
    far = _distances(sample, centre)
    own, r = far.argmin(1), far.min(1)
    rings = [np.unique(np.quantile(r[own == p], np.linspace(0, 1, 1 + max(1, min(64, round(n * (own == p).mean() / block_rows))))[1:-1])) if (own == p).any() else np.zeros(0) for p in range(len(centre))]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                vec = _matrix(b.column("vec"), dim)
                d = _distances(_lifted(vec, top), centre)
                p, r = d.argmin(1), d.min(1)
                ring = np.array([np.searchsorted(rings[i], x) for i, x in zip(p, r, strict=True)], np.int32)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([v.tobytes() for v in vec], pa.binary()), pa.array(p.astype(np.int32)), pa.array(ring), pa.array(r)], names=["id", "vec", "pivot", "ring", "r"])

    index = written(sound.mapInArrow(keyed, "id long, vec binary, pivot int, ring int, r double"))
    shells = index.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("r").alias("near"), F.max("r").alias("far")).orderBy("pivot", "ring").toPandas()  # pivots times 64 at most
    shells["parts"] = np.ceil(shells["n"] / block_rows).astype(int)
    shells["first"] = shells["parts"].cumsum() - shells["parts"]
    first = {(p, g): (f, m) for p, g, f, m in shells[["pivot", "ring", "first", "parts"]].itertuples(index=False)}
    shell_of = spark.createDataFrame(shells[["pivot", "ring", "first", "parts"]].astype("int64"), "pivot int, ring int, first long, parts long")
    blocked = index.join(F.broadcast(shell_of), ["pivot", "ring"]).select((F.col("first") + F.pmod(F.xxhash64("id", "vec"), F.col("parts"))).alias("block"), F.lit(0).alias("kind"), "id", "vec", F.lit(0).cast("long").alias("least"))
    least_long = -(2**63)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                vec, ids = _matrix(b.column("vec"), dim), b.column("id").to_numpy()
                d = _distances(_lifted(vec, top), centre)
                p = d.argmin(1)
                at = [first.get((i, int(np.searchsorted(rings[i], x)))) for i, x in zip(p, d.min(1), strict=True)]
                block = [f + int(i) % m for (f, m), i in zip(at, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(np.ones(len(ids), np.int32)), b.column("id"), pa.array([v.tobytes() for v in vec], pa.binary()), pa.array(np.full(len(ids), least_long))], names=["block", "kind", "id", "vec", "least"])

    schema = "block long, kind int, id long, vec binary, least long"
    nearby = _search(blocked.unionByName(queries.mapInArrow(home, schema)), dim, k)
    floor = nearby.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("query_id", F.when(F.size("s") >= k, F.col("s")[k - 1]).alias("least"))
    asked = queries.join(floor, queries["id"] == floor["query_id"], "left").select("id", "vec", F.coalesce("least", F.lit(least_long)).alias("least"))
    sp, sn, sf, sa, sm = (shells[c].to_numpy() for c in ("pivot", "near", "far", "first", "parts"))

    def annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vec, least = _matrix(b.column("vec"), dim), b.column("least").to_numpy()
            flat = np.hstack([vec.astype(np.float64), np.zeros((len(vec), 1))])
            d = _distances(flat, centre)[:, sp]
            low = np.maximum(0, np.maximum(sn - d, d - sf))
            low = np.maximum(0, low - 1e-6 * (1 + np.sqrt(top)))
            most = ((flat * flat).sum(1)[:, None] + top - low * low) / 2
            i, j = np.nonzero(most * (1 + 1e-9) + 1 >= least.astype(np.float64)[:, None])
            many = sm[j]
            i, j = np.repeat(i, many), np.repeat(j, many)
            part = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            raw = [v.tobytes() for v in vec]
            ids = b.column("id").to_numpy()
            for z in range(0, len(i), 20_000):
                a, c = i[z : z + 20_000], j[z : z + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(sa[c] + part[z : z + 20_000], pa.int64()), pa.array(np.ones(len(a), np.int32)), pa.array(ids[a]), pa.array([raw[x] for x in a], pa.binary()), pa.array(least[a])], names=["block", "kind", "id", "vec", "least"])

    found = _search(blocked.unionByName(asked.mapInArrow(annuli, schema)), dim, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
