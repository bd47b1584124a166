"""De-duplication of sequences, cluster maps, consensus sequences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.functions.sequence import GAP, IUPAC, RUN_GAP, characters, sequence_key
from seqlake.operators.tables import chunks


def dedup_sequences(seqs: DataFrame, group: list[str] | None = None, fallback: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, map, weights) of sequences (id, seq, _ord): equal ones in a group, whatever their case, fall on the first.

    group: columns whose value is the group; where one is empty the fallback column of the same place stands in.
    map: kept, orig; weights: kept, weight. Keys are digests, so sequences themselves aren't shuffled for the aggregation.
    """
    parts = [F.coalesce(F.nullif(F.col(g), F.lit("")), *([F.col(f)] if f else [])) for g, f in zip(group or [], fallback or [None] * len(group or []), strict=True)]
    keyed = seqs.withColumn("__key", F.struct(*[p.alias(f"g{i}") for i, p in enumerate(parts)], sequence_key(F.col("seq")).alias("digest")))
    first = keyed.groupBy("__key").agg(F.min(F.struct("_ord", "id")).alias("__first"), F.count("*").alias("weight"))
    mapped = keyed.join(first, "__key").select(F.col("__first.id").alias("kept"), F.col("id").alias("orig"))
    weights = first.select(F.col("__first.id").alias("kept"), "weight")
    kept = keyed.join(first.select(F.col("__first.id").alias("id"), F.col("__first._ord").alias("_ord")), ["id", "_ord"], "left_semi").drop("__key")
    return kept, mapped, weights


def read_map(uc: DataFrame) -> DataFrame:
    """read, cluster of a cluster table: seeds (S) belong to themselves, hits (H) to their target; C rows only give sizes."""
    return uc.where(F.col("type").isin("S", "H")).select(F.col("query_label").alias("read"), F.when(F.col("type") == "S", F.col("query_label")).otherwise(F.col("target_label")).alias("cluster"))


def cluster_sizes(uc: DataFrame) -> DataFrame:
    return uc.where("type = 'C'").select(F.col("query_label").alias("cluster"), "size")


def group_ratios(groups: DataFrame) -> DataFrame:
    """group, ratio: rows of the rarest group over rows of each (groups: read, group)."""
    n = groups.groupBy("group").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.min("n").alias("least")))).select("group", (F.col("least") / F.col("n")).alias("ratio"))  # one row


def map_clusters(uc: DataFrame, specimens: DataFrame | None = None, groups: DataFrame | None = None, least: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(read map, specimen map, weights) of a cluster table, for clusters of at least `least` reads.

    weights: reads of a cluster, or the sum of their groups' ratios. specimens: read, specimen.
    """
    reads = read_map(uc)
    large = reads.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    reads = reads.join(large, "cluster").select("read", "cluster", "n")
    if groups is None:
        weights = reads.groupBy("cluster").agg(F.max("n").cast("double").alias("weight"))
    else:
        ratio = groups.join(F.broadcast(group_ratios(groups)), "group").select("read", "ratio")
        weights = reads.join(ratio, "read").groupBy("cluster").agg(F.sum("ratio").alias("weight"))
    named = specimens if specimens is not None else reads.select("read", F.col("read").alias("specimen"))
    return reads.select("read", "cluster"), reads.join(named, "read").select("cluster", "specimen").distinct(), weights


def composition(aligned: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """by, pos (from 0), base, n: how often a base stands at a place; an ambiguity code counts for each of its bases."""
    codes = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])
    each = aligned.select(*by, F.posexplode(characters(F.upper(seq))).alias("pos", "code"))
    bases = each.select(*by, "pos", F.explode(characters(F.coalesce(F.try_element_at(codes, F.col("code")), F.col("code")))).alias("base"))
    return bases.groupBy(*by, "pos", "base").agg(F.count("*").alias("n"))


def consensus(aligned: DataFrame, by: list[str], seq: str = "seq", keep_gaps: bool = False) -> DataFrame:
    """by, consensus of aligned sequences: a gap where gaps are more than half, else the code of the most frequent bases."""
    counts = composition(aligned, by, seq)
    gap = F.col("base").isin(GAP, RUN_GAP)
    place = counts.groupBy(*by, "pos").agg(F.sum("n").alias("all"), F.sum(F.when(gap, F.col("n")).otherwise(0)).alias("gaps"), F.collect_list(F.when(~gap, F.struct("n", "base"))).alias("bases"))
    top = F.array_max(F.transform("bases", lambda x: x["n"]))
    best = F.array_join(F.array_sort(F.transform(F.filter("bases", lambda x: x["n"] == top), lambda x: x["base"])), "")
    code = F.create_map(*[F.lit(x) for c, b in IUPAC.items() for x in (b, c)])
    letter = F.when(F.col("gaps") > 0.5 * F.col("all"), F.lit(GAP if keep_gaps else "")).otherwise(F.coalesce(F.try_element_at(code, best), F.lit("N")))
    called = place.select(*by, "pos", letter.alias("c"))
    return called.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]), "").alias("consensus"))


def consensus_lengths(runs: DataFrame, by: list[str], most: bool = False) -> DataFrame:
    """by, pos, length: the most frequent run length at a place (by, pos, len; a gap counts as 1); ties go to the smallest, or to the largest."""
    n = runs.withColumn("len", F.coalesce("len", F.lit(1))).groupBy(*by, "pos", "len").agg(F.count("*").alias("n"))
    tie = F.col("len") if most else -F.col("len")
    return n.groupBy(*by, "pos").agg(F.max_by("len", F.struct(F.col("n"), tie)).alias("length"))


def align_star(seqs: list[str]) -> list[str]:
    """A multiple alignment around the longest sequence, by global pairwise alignments."""
    from seqlake.operators.kernels import global_alignment

    centre = max(range(len(seqs)), key=lambda i: (len(seqs[i]), -i))
    master, rows = seqs[centre], {centre: seqs[centre]}
    for i, s in enumerate(seqs):
        if i == centre:
            continue
        new, own = global_alignment(master, s)
        if new != master:  # gaps that this pair puts into the master go into all rows
            places, k = [], 0
            for c in new:
                if k < len(master) and c == master[k]:
                    places.append(k)
                    k += 1
                else:
                    places.append(None)
            rows = {j: "".join(GAP if p is None else r[p] for p in places) for j, r in rows.items()}
            master = new
        rows[i] = own
    return [rows[i] for i in range(len(seqs))]


def align_clusters(seqs: DataFrame, by: list[str], id_col: str = "id") -> DataFrame:
    """by, id, seq (aligned): a multiple alignment of each group; groups are cut to a bounded size first (see denoise)."""
    kept = seqs.select(*by, F.col(id_col).alias("id"), "seq")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        frame["seq"] = align_star(frame["seq"].tolist())
        return frame

    return kept.groupBy(*by).applyInPandas(one, kept.schema)


def denoise(seqs: DataFrame, clusters: DataFrame, groups: DataFrame | None = None, least: int = 1, most: int = 1000, prefix: str = "cons", suffix: str = "", aligned: bool = False) -> DataFrame:
    """name, consensus, weight, reads: consensus sequences of clusters, equal ones merged, the heaviest first.

    seqs: id, seq; clusters: read, cluster (a read without one is a cluster of its own). Clusters over `most` reads are
    cut into parts. Single reads skip alignment. With groups (read, group) reads weigh by their group's ratio among the
    reads that stay.
    """
    read = seqs.join(clusters.withColumnRenamed("read", "id"), "id", "left").select("id", "seq", F.coalesce("cluster", "id").alias("cluster"))
    size = read.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    read = chunks(read.join(size, "cluster"), most, ["cluster"])
    single = read.where("n = 1").select("cluster", "chunk", F.upper("seq").alias("consensus"))
    many = read.where("n > 1")
    placed = many if aligned else align_clusters(many, ["cluster", "chunk"])
    called = single.unionByName(consensus(placed, ["cluster", "chunk"]))
    weight = read.select("id", F.lit(1.0).alias("w"))
    if groups is not None:
        own = groups.withColumnRenamed("read", "id").join(read.select("id"), "id", "left_semi")
        weight = own.join(F.broadcast(group_ratios(own.withColumnRenamed("id", "read"))), "group").select("id", F.col("ratio").alias("w"))
    member = read.join(weight, "id").groupBy("cluster", "chunk").agg(F.sum("w").alias("w"), F.collect_list("id").alias("ids"))
    merged = called.join(member, ["cluster", "chunk"]).groupBy("consensus").agg(F.sum("w").alias("weight"), F.flatten(F.collect_list("ids")).alias("ids"))
    number = F.row_number().over(Window.orderBy(F.desc("weight"), "consensus"))
    named = F.concat(F.lit(prefix), F.lpad(number.cast("string"), 4, "0"), F.lit("_"), F.round("weight").cast("long").cast("string"), F.lit(suffix))
    return merged.select(named.alias("name"), "consensus", "weight", F.array_sort("ids").alias("reads"))
