"""Shards of near-equal bytes by Karmarkar-Karp differencing over indivisible groups.

A partial partition is a vector of shard sums. The two with the largest spread are
combined in opposite order, largest sum with smallest, again and again until one is
left. Groups (equal texts) are differenced in three passes, each of bounded size per task:

1. groups above one part in ``LARGE`` of all bytes, of which there are ``LARGE`` at most;
2. all others in hashed blocks, each together with its share of the sums of pass 1 as a
   partial partition, so every block evens out the same share of what the large ones left;
3. one block kept back, together with the sums of all others, which closes the rest.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import dense_number
from maskwright.sources.staging import stage

SHARDS = 40
OVERHEAD = 16
LARGE = 20_000
BLOCK_GROUPS = 2_000


def difference(sizes: np.ndarray, shards: int, start: np.ndarray | None = None) -> np.ndarray:
    """Shard of each item; ``start`` is a partial partition that keeps its labels.

    A node holds shard sums in descending order. Combining two adds the second in
    ascending order. Shards of items follow by undoing the combinations from the last.
    """
    n = len(sizes)
    labelled = start is not None
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(-np.asarray(sizes, np.float64), kind="stable")
    sums: dict[int, np.ndarray] = {}
    heap: list[tuple[float, int]] = []
    one = np.zeros(shards)
    for i in order:
        sums[int(i)] = (own := one.copy())
        own[0] = sizes[i]
        heap.append((-float(sizes[i]) if shards > 1 else 0.0, int(i)))
    labels = np.arange(shards)
    if labelled:
        labels = np.argsort(-start, kind="stable")
        sums[n] = np.asarray(start, np.float64)[labels]
        heap.append((-(sums[n][0] - sums[n][-1]), n))
    heapq.heapify(heap)
    merges, node = [], n + 1
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        to = np.argsort(-both, kind="stable")
        sums[node] = both[to]
        merges.append((a, b, to))
        heapq.heappush(heap, (-(sums[node][0] - sums[node][-1]), node))
        node += 1
    # place[x][k]: the final position of node x's k-th shard
    place = {heap[0][1]: np.arange(shards)}
    for a, b, to in reversed(merges):
        node -= 1
        above = place.pop(node)
        back = np.empty(shards, np.int64)
        back[to] = above
        place[a], place[b] = back, back[::-1]
    final = np.array([place[i][0] for i in range(n)])
    if not labelled:
        return final
    name = np.empty(shards, np.int64)
    name[place[n]] = labels
    return name[final]


def _assign(groups: DataFrame, shards: int, start: np.ndarray | None) -> DataFrame:
    """Difference each ``block`` of ``key bytes block`` rows by itself."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True])
        return pd.DataFrame({"key": pdf["key"], "bytes": pdf["bytes"], "shard": difference(pdf["bytes"].to_numpy(np.float64), shards, start)})

    return groups.groupBy("block").applyInPandas(work, "key string, bytes long, shard int")


def _sums(placed: DataFrame, shards: int) -> np.ndarray:
    out = np.zeros(shards)
    for row in placed.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():  # a row per shard
        out[row["shard"]] = row["bytes"]
    return out


def assign_groups(groups: DataFrame, shards: int = SHARDS, large: int = LARGE, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """``key bytes shard`` for a written table of groups ``key bytes``, keys not repeated.

    The driver sees a count, a total and one sum per shard.
    """
    whole = groups.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    blocks = max(1, -(-whole["n"] // block_groups))
    limit = (whole["bytes"] or 0) / large
    block = F.pmod(F.xxhash64("key"), F.lit(blocks))
    tagged = groups.withColumn("block", F.when(F.col("bytes") > limit, F.lit(-1)).otherwise(block).cast("long"))
    top = stage(_assign(tagged.filter("block = -1"), shards, None))
    sums = _sums(top, shards)
    middle = stage(_assign(tagged.filter("block > 0"), shards, sums / blocks))
    closing = _assign(tagged.filter("block = 0"), shards, sums + _sums(middle, shards))
    return stage(top.unionAll(middle).unionAll(closing))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id size text_crc32 law shard slot grown_shard`` for every row.

    A row's size is its text's UTF-8 bytes plus 16; equal texts share a shard, and null
    counts as the empty text. A group larger than a shard's share fills a shard alone.
    Slots count from 0 without gaps in each shard. Null ids and repeated rows are rows
    like any other. Groups are reduced before they meet, and the join back leaves
    skewed groups to adaptive execution.
    """
    text = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("key"),
        )
    )
    groups = stage(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    placed = stage(rows.join(assign_groups(groups, shards).select("key", "shard"), "key").drop("key"))
    slotted = dense_number(placed, ["shard"], ["doc_id", "text_crc32"], "slot")
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
