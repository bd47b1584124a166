"""Op 4: minimum-cost-flow resharding.

Documents lie in old shards. Each old shard is cut into a fixed number of blocks by a hash of the rows, so that what the
driver plans with (bytes and rows of each block) has a size that doesn't depend on the input. From the bytes of the old
shards and the capacities of the new ones, a minimum-cost flow (staying costs nothing, moving costs one a byte) says how
many bytes go from which shard to which; blocks are then dealt to these flows, largest first, and small blocks even out
what is left. A document's slot in its shard is its block's offset and its place in the block.

Law `bytes`: sizes of the shards are near equal (up to the smallest blocks). Size of a document: UTF-8 bytes of its text and one; a null text
has no bytes and is like an empty one. Rows with equal ids, or wholly equal rows, are rows of their own and get slots of
their own. An empty table gives an empty plan. Rows whose old shard is null lie in no shard yet: they are dealt like a shard of
their own, NO_SHARD, and all of them move.
"""

from __future__ import annotations

import heapq
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import fresh

#: Blocks in each old shard: the unit of transfers, and the bound of what the driver gets (times the number of shards).
BLOCKS = 2048
#: Stands for a null old shard while planning; results show null again.
NO_SHARD = -(2**31)


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Amounts (i, j) -> units that carry all supply within the capacities at least cost; cost(i, j) is by unit.

    Successive shortest paths with potentials on the graph source -> i -> j -> sink.
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    to: list[int] = []
    cap: list[int] = []
    price: list[int] = []
    at: list[list[int]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, c: int, p: int) -> None:
        for x, y, k, q in ((a, b, c, p), (b, a, 0, -p)):
            at[x].append(len(to))
            to.append(y)
            cap.append(k)
            price.append(q)

    total = sum(supply)
    if sum(capacity) < total:
        raise ValueError("capacities are smaller than the supply")
    for i, s in enumerate(supply):
        edge(source, i, s, 0)
    arcs = {}
    for i in range(n):
        for j in range(m):
            arcs[i, j] = len(to)
            edge(i, n + j, total, cost(i, j))
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    potential = [0] * (n + m + 2)
    left = total
    while left:
        far = {source: 0}
        by: dict[int, int] = {}
        queue = [(0, source)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in at[x]:
                if cap[e]:
                    y = to[e]
                    own = d + price[e] + potential[x] - potential[y]
                    if own < far.get(y, own + 1):
                        far[y] = own
                        by[y] = e
                        heapq.heappush(queue, (own, y))
        most = max(far.values())
        for x in range(n + m + 2):
            potential[x] += far.get(x, most)
        flow, x = left, sink
        while x != source:
            flow = min(flow, cap[by[x]])
            x = to[by[x] ^ 1]
        x = sink
        while x != source:
            cap[by[x]] -= flow
            cap[by[x] ^ 1] += flow
            x = to[by[x] ^ 1]
        left -= flow
    return {k: cap[e ^ 1] for k, e in arcs.items() if cap[e ^ 1]}


def deal(blocks: pd.DataFrame, shards: int, capacity: list[int] | None = None) -> pd.DataFrame:
    """blocks (old_shard, block, bytes, rows) with shard and first_slot.

    The blocks of each old shard are dealt to its flows, the largest block to the flow with most left; then blocks go
    from the fullest shard to the emptiest for as long as that evens them out.
    """
    blocks = blocks.sort_values(["bytes", "old_shard", "block"], ascending=[False, True, True], ignore_index=True)
    olds = sorted(set(blocks["old_shard"]))
    supply = [int(blocks.loc[blocks["old_shard"] == i, "bytes"].sum()) for i in olds]
    total = sum(supply)
    capacity = capacity or [total // shards + (j < total % shards) for j in range(shards)]
    left = {(olds[i], j): x for (i, j), x in min_cost_flow(supply, capacity, lambda i, j: int(olds[i] != j)).items()}
    ways = {i: [j for a, j in left if a == i] for i in olds}
    load, own = [0] * shards, []
    for i, size in zip(blocks["old_shard"], blocks["bytes"], strict=True):
        j = max(ways[i], key=lambda j: (left[i, j], j == i))
        left[i, j] -= size
        load[j] += size
        own.append(j)
    held: dict[int, list[int]] = {j: [] for j in range(shards)}
    for x, j in enumerate(own):
        held[j].append(x)
    size_of, home = blocks["bytes"].tolist(), blocks["old_shard"].tolist()
    for _ in range(4 * shards):
        over = [load[j] - capacity[j] for j in range(shards)]
        a, b = over.index(max(over)), over.index(min(over))
        gap = over[a] - over[b]
        # a block that has left its shard anyway, or comes home, costs no more bytes: it goes if it halves the gap
        costs = lambda x: home[x] == a and home[x] != b
        fits = [x for x in held[a] if size_of[x] < gap]
        free = [x for x in fits if not costs(x) and gap <= 4 * size_of[x] <= 3 * gap]
        x = min(free or fits, key=lambda x: (abs(2 * size_of[x] - gap), x), default=None)
        if x is None:
            break
        held[a].remove(x)
        held[b].append(x)
        load[a] -= size_of[x]
        load[b] += size_of[x]
        own[x] = b
    blocks["shard"] = own
    blocks = blocks.sort_values(["shard", "old_shard", "block"], ignore_index=True)
    blocks["first_slot"] = blocks.groupby("shard")["rows"].cumsum() - blocks["rows"]
    return blocks


def reshard(docs: DataFrame, old_shard: Column, shards: int, blocks: int = BLOCKS, capacity: list[int] | None = None) -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, old_shard, block, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(old_shard.cast("int"), F.lit(NO_SHARD)).alias("old_shard"),
    )
    sized = sized.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks)).cast("int"))
    counted = sized.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas()  # old shards times blocks at most
    plan = deal(counted, shards, capacity) if len(counted) else counted.assign(shard=[], first_slot=[])
    plan = spark.createDataFrame(plan.astype("int64"), "old_shard long, block long, bytes long, rows long, shard long, first_slot long").select(F.col("old_shard").cast("int"), F.col("block").cast("int"), F.col("shard").cast("int"), "first_slot")
    place = F.row_number().over(Window.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size"))
    return sized.withColumn("place", place).join(F.broadcast(plan), ["old_shard", "block"]).select("doc_id", "size", "text_crc32", F.nullif("old_shard", F.lit(NO_SHARD)).alias("old_shard"), "block", "shard", (F.col("first_slot") + F.col("place") - 1).alias("slot"))


def rewrite(docs: DataFrame, old_shard: Column, shards: int, to: str, blocks: int = BLOCKS) -> list[int]:
    """Write anew, under to/shard=N, the shards that lose or gain documents; returns their numbers. Others stay as they are.

    The new shards are written to a folder of their own first and then take the places of the old ones, so docs may be read
    from `to`; a changed shard that keeps no document goes. A column `shard` of docs is replaced by the folders' numbers; other
    columns are written as they are.
    """
    old, part = fresh(docs, "old"), fresh(docs, "part")
    rows = docs.withColumn(old, F.coalesce(old_shard.cast("int"), F.lit(NO_SHARD))).drop("shard")
    moves = reshard(docs, old_shard, shards, blocks).select(F.coalesce("old_shard", F.lit(NO_SHARD)).alias("old_shard"), "block", "shard").distinct()
    changed = [r[0] for r in moves.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard"))).distinct().collect()]  # shards at most
    changed = sorted(set(changed) - {NO_SHARD})
    if not changed:
        return []
    text = F.coalesce(F.col("text"), F.lit(""))
    block = F.pmod(F.xxhash64("doc_id", F.crc32(text), (F.octet_length(text) + 1).cast("long")), F.lit(blocks)).cast("int")
    placed = rows.withColumn(part, block).join(F.broadcast(moves.toDF(old, part, "shard")), [old, part]).where(F.col("shard").isin(changed))
    staging = f"{to}/_resharding-{uuid.uuid4().hex}"  # readers skip names with a leading underscore
    placed.drop(old, part).write.partitionBy("shard").parquet(f"{staging}/new")
    _swap(docs, staging, to, changed)
    return changed


def _swap(docs: DataFrame, staging: str, to: str, changed: list[int]) -> None:
    """Each changed shard's new folder in place of its old one, which is deleted after all have changed places."""
    sc = docs.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    fs = path(to).getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{staging}/old"))
    for j in changed:
        for a, b in ((f"{to}/shard={j}", f"{staging}/old/shard={j}"), (f"{staging}/new/shard={j}", f"{to}/shard={j}")):
            if fs.exists(path(a)) and not fs.rename(path(a), path(b)):
                raise OSError(f"can't move {a} to {b}; {staging} holds the shards")
    fs.delete(path(staging), True)
