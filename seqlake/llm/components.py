"""Connected components of a large graph, by alternating large-star and small-star steps.

Every step is two joins on a node and aggregations that combine before they shuffle; a node with very many links is split
by adaptive joins. The edges of each round are written to the shared folder, so a lost executor costs no earlier round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import drop_written, written


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) with the components of the edges a-b; least nodes are left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        if (label == before).all():
            break
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition, as stars, in runs of bounded length."""
    u, v, n = [], [], 0
    for b in batches:
        u.append(b.column("u").to_numpy())
        v.append(b.column("v").to_numpy())
        n += b.num_rows
        if n >= 2_000_000:
            yield _batch(*stars(np.concatenate(u), np.concatenate(v)))
            u, v, n = [], [], 0
    if n:
        yield _batch(*stars(np.concatenate(u), np.concatenate(v)))


def _batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, starred: bool = False) -> DataFrame:
    """From edges (u long, v long), in any direction and repeated or not, to (u, root) of every node that isn't a root.
    starred: they are what local() makes, which then needs no worker of its own."""
    now = written(edges if starred else edges.where("u <> v").mapInArrow(local, "u long, v long"))
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        drop_written(now)
        was, mark, now = mark, _mark(new), new
        if mark == was:
            break
    return now.select("u", F.col("v").alias("root"))
