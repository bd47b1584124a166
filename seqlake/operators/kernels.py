"""Pairwise alignment kernels in numpy, and the joins that use them.

Search statistics of library programs (z-scores, E-values) aren't computed; identity, overlap and coordinates are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.functions.sequence import GAP

MATCH, MISMATCH, OPEN, EXTEND = 5, -4, -12, -4
#: Cells of the tables that pairs are filled in together; a longer pair has tables of its own.
CELLS = 1 << 20


def _filled(pairs: list[tuple[str, str]], local: bool, opened: int, extended: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Affine-gap score tables of several pairs at once, row by row: best, gap in a, gap in b. What is beyond a pair's own
    lengths means nothing; no cell depends on one further down or to the right."""
    n, m = (max(len(p[side]) for p in pairs) for side in (0, 1))
    x, y = np.zeros((len(pairs), n), np.uint8), np.zeros((len(pairs), m), np.uint8)
    for k, p in enumerate(pairs):
        for table, s in zip((x, y), p, strict=True):
            table[k, : len(s)] = np.frombuffer(s.encode("latin-1", "replace"), np.uint8)
    low = -(10**8)
    best, in_a, in_b = (np.full((len(pairs), n + 1, m + 1), low, np.int32) for _ in range(3))
    best[:, 0, 0] = 0
    if local:
        best[:, 0, :] = best[:, :, 0] = 0
    else:
        in_a[:, 0, 1:] = best[:, 0, 1:] = opened + extended * np.arange(m)
        in_b[:, 1:, 0] = best[:, 1:, 0] = opened + extended * np.arange(n)
    step = (extended * np.arange(m + 1)).astype(np.int32)
    for i in range(1, n + 1):
        in_b[:, i, 1:] = np.maximum(best[:, i - 1, 1:] + opened, in_b[:, i - 1, 1:] + extended)
        row = np.maximum(best[:, i - 1, :-1] + np.where(y == x[:, i - 1 : i], np.int32(MATCH), np.int32(MISMATCH)), in_b[:, i, 1:])
        if local:
            row = np.maximum(row, 0)
        # a gap in a that began at k: best[k] + opened + extended * (j - k - 1), by a running maximum
        start = np.concatenate([best[:, i, :1], row], axis=1)
        run = np.maximum.accumulate(start - step, axis=1)[:, :-1] + step[1:] - extended + opened
        in_a[:, i, 1:] = run
        best[:, i, 1:] = np.maximum(row, run)
    return best, in_a, in_b


def _traced(a: str, b: str, tables: tuple[np.ndarray, np.ndarray, np.ndarray], local: bool, opened: int, extended: int) -> tuple[int, str, str, int, int]:
    best, in_a, in_b = (t[: len(a) + 1, : len(b) + 1] for t in tables)
    i, j = np.unravel_index(best.argmax(), best.shape) if local else (len(a), len(b))
    i, j, score = int(i), int(j), int(best[i, j])
    left, right, state = [], [], "best"
    while (i or j) and not (local and state == "best" and best[i, j] == 0):
        if state == "best":
            if i and j and best[i, j] == best[i - 1, j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH):
                left.append(a[i - 1])
                right.append(b[j - 1])
                i, j = i - 1, j - 1
                continue
            state = "a" if best[i, j] == in_a[i, j] else "b"
        if state == "a":
            left.append(GAP)
            right.append(b[j - 1])
            state = "best" if in_a[i, j] == best[i, j - 1] + opened else "a"
            j -= 1
        else:
            left.append(a[i - 1])
            right.append(GAP)
            state = "best" if in_b[i, j] == best[i - 1, j] + opened else "b"
            i -= 1
    return score, "".join(reversed(left)), "".join(reversed(right)), i, j



def aligned_all(pairs: list[tuple[str, str]], local: bool = True, opened: int = OPEN, extended: int = EXTEND) -> list[tuple[int, str, str, int, int]]:
    """aligned() of each pair; pairs of like lengths are filled together, in tables of some CELLS cells."""
    out: list = [None] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    at = 0
    while at < len(order):
        end, n, m = at, 0, 0
        while end < len(order):
            a, b = pairs[order[end]]
            n, m = max(n, len(a) + 1), max(m, len(b) + 1)
            if end > at and (end - at + 1) * n * m > CELLS:
                break
            end += 1
        some = order[at:end]
        tables = _filled([pairs[k] for k in some], local, opened, extended)
        for i, k in enumerate(some):
            out[k] = _traced(*pairs[k], tuple(t[i] for t in tables), local, opened, extended)
        at = end
    return out


def aligned(a: str, b: str, local: bool = True, opened: int = OPEN, extended: int = EXTEND) -> tuple[int, str, str, int, int]:
    """(score, a with gaps, b with gaps, start in a, start in b) of the best alignment; starts are from 0."""
    return aligned_all([(a, b)], local, opened, extended)[0]


def global_alignment(a: str, b: str) -> tuple[str, str]:
    _, x, y, _, _ = aligned(a, b, local=False)
    return x, y


def align_pairs(pairs: DataFrame, local: bool = True) -> DataFrame:
    """pairs (…, q_seq, t_seq) with score, ident (of the overlap), overlap, q_start, q_end, t_start, t_end (from 1), q_al, t_al."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            pairs = [((a or "").upper(), (b or "").upper()) for a, b in zip(f["q_seq"], f["t_seq"], strict=True)]
            for s, x, y, i, j in aligned_all(pairs, local):
                same = sum(c == d for c, d in zip(x, y, strict=True))
                rows.append((s, same / len(x) if x else 0.0, len(x), i + 1, i + len(x.replace(GAP, "")), j + 1, j + len(y.replace(GAP, "")), x, y))
            yield pd.concat([f.reset_index(drop=True), pd.DataFrame(rows, columns=NAMES)], axis=1)

    kinds = ["int", "double", "int", "int", "int", "int", "int", "string", "string"]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema] + [f"{n} {k}" for n, k in zip(NAMES, kinds, strict=True)])
    return pairs.mapInPandas(run, schema)


NAMES = ["score", "ident", "overlap", "q_start", "q_end", "t_start", "t_end", "q_al", "t_al"]


def kmer_candidates(queries: DataFrame, targets: DataFrame, k: int = 11, least: int = 1, frequent: int = 10_000) -> DataFrame:
    """q_id, t_id of pairs that share at least `least` different words of k bases; words in more than `frequent` targets are joined in parts of about that many."""
    words = lambda df, name: df.where(F.length("seq") >= k).select(F.col("id").alias(name), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("seq") - k + 1), lambda i: F.substr(F.upper("seq"), i, F.lit(k))))).alias("word"))
    t = words(targets, "t_id")
    crowded = t.groupBy("word").count().where(F.col("count") > frequent).select("word", F.ceil(F.col("count") / frequent).alias("parts"))
    salted = lambda df, part: df.join(F.broadcast(crowded), "word", "left").withColumn("part", part(F.coalesce("parts", F.lit(1)))).drop("parts")
    q = salted(words(queries, "q_id"), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return q.join(salted(t, lambda n: F.pmod(F.xxhash64("t_id"), n)), ["word", "part"]).groupBy("q_id", "t_id").agg(F.count("*").alias("words")).where(F.col("words") >= least)


def search(queries: DataFrame, targets: DataFrame, identity: float = 0.0, k: int = 11, least: int = 1, best_only: bool = False) -> DataFrame:
    """q_id, t_id and the columns of align_pairs: local alignments of pairs with common seeds, of at least this identity."""
    pairs = kmer_candidates(queries, targets, k, least)
    joined = pairs.join(queries.select(F.col("id").alias("q_id"), F.col("seq").alias("q_seq")), "q_id").join(targets.select(F.col("id").alias("t_id"), F.col("seq").alias("t_seq")), "t_id")
    out = align_pairs(joined.select("q_id", "t_id", "q_seq", "t_seq")).where(F.col("ident") >= identity)
    if not best_only:
        return out
    best = out.groupBy("q_id").agg(F.max_by(F.struct(*[c for c in out.columns if c != "q_id"]), F.struct("score", "ident")).alias("b"))
    return best.select("q_id", "b.*")


def all_pairs(seqs: DataFrame) -> DataFrame:
    """q_id, t_id and the columns of align_pairs for each of the n (n - 1) / 2 pairs (id, seq, place). The result is that large by definition."""
    a = seqs.select(F.col("id").alias("q_id"), F.col("seq").alias("q_seq"), F.col("place").alias("i"))
    b = seqs.select(F.col("id").alias("t_id"), F.col("seq").alias("t_seq"), F.col("place").alias("j"))
    return align_pairs(a.join(b, F.col("i") < F.col("j")).select("q_id", "t_id", "q_seq", "t_seq"))
