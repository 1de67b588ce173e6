"""Balanced shards by Karmarkar-Karp differencing.

Documents with the same text are a group that stays together. A group larger
than an even share of all bytes cannot, so it is first cut by a hash of the ids
into parts of at most half such a share. There are at most as many of those as
twice the shards, which bounds what is broadcast.

Differencing starts from one partial partition per group (its size, and zeros)
and repeatedly joins the two with the largest spread, the larger sums of one on
the smaller sums of the other. At scale the ``chunk`` largest groups are
differenced in one task. Their partial partition, divided by the number of
chunks, then enters each chunk of the smaller groups as one more partial
partition; so every chunk evens out its part of what the large groups left
uneven, and all chunks name their subsets by those of the large groups.

Defined cases: a null text has no bytes and forms one group with other nulls,
not with empty texts; a document's size is its bytes plus ``overhead``, so none
is 0; ids may be null or repeat; an empty table gives no rows. Only the id and
text columns are read. A hash collision of two texts only keeps both together.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm.common import load, materialise, running_total

SHARDS = 24
OVERHEAD = 8
#: Groups that a task differences.
CHUNK = 20_000


def difference(parts: list[tuple[list[int], object]], k: int):
    """Join partial partitions until one is left.

    Each comes as (k sums, key). Returns its sums and, for every key, the place
    of each of the key's k subsets in the result.
    """
    heap, trees = [], []
    for sums, key in parts:
        order = sorted(range(k), key=lambda i: sums[i])
        ranked = [sums[i] for i in order]
        trees.append((key, order))
        heap.append((ranked[0] - ranked[-1], len(trees) - 1, ranked))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, up = heapq.heappop(heap)
        _, b, down = heapq.heappop(heap)
        # the largest sums of one meet the smallest of the other
        both = [x + y for x, y in zip(up, reversed(down))]
        order = sorted(range(k), key=both.__getitem__)
        ranked = [both[i] for i in order]
        trees.append((a, b, order))
        heapq.heappush(heap, (ranked[0] - ranked[-1], len(trees) - 1, ranked))
    if not heap:
        return [0] * k, {}
    _, root, sums = heap[0]
    places, todo = {}, [(root, list(range(k)))]
    while todo:
        node, at = todo.pop()  # at[r]: place in the result of the subset of rank r
        if len(trees[node]) == 2:
            key, order = trees[node]
            places[key] = [0] * k
            for rank, subset in enumerate(order):
                places[key][subset] = at[rank]
        else:
            a, b, order = trees[node]
            back = [0] * k
            for rank, i in enumerate(order):
                back[i] = at[rank]
            todo += [(a, back), (b, back[::-1])]
    return sums, places


def _differenced(groups: DataFrame, k: int, first: list[int] | None) -> DataFrame:
    """(group, shard, left) for groups of (chunk, group, bytes), written.

    *first* is a partial partition that joins each chunk and names the shards.
    One row per chunk has no group but the sums of the chunk's shards.
    """

    def run(table):
        import pyarrow as pa

        keys, sizes = table.column("group").to_pylist(), table.column("bytes").to_pylist()
        parts = [([n] + [0] * (k - 1), (0, g)) for g, n in zip(keys, sizes)]
        if first:
            parts.append((first, (1, 0)))
        sums, places = difference(parts, k)
        names = list(range(k))
        if first:
            for subset, place in enumerate(places[1, 0]):
                names[place] = subset
        return pa.table(
            {
                "group": [*keys, None],
                "shard": [*(names[places[0, g][0]] for g in keys), None],
                "left": [*[None] * len(keys), sums],
            },
            pa.schema([("group", pa.int64()), ("shard", pa.int32()),
                       ("left", pa.list_(pa.int64()))]),
        )

    return materialise(
        groups.groupBy("chunk").applyInArrow(run, "group long, shard int, left array<long>"),
        "differenced",
    )


def assign(groups: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """(group, shard) for groups of (group long, bytes long), a written table."""
    n_groups = groups.count()
    # the least size among the largest groups: at most *chunk* rows on the driver's side
    least = groups.orderBy(F.desc("bytes")).limit(chunk).agg(F.min("bytes")).first()[0] or 0
    least = least if n_groups > chunk else -1
    large = groups.where(F.col("bytes") > least).withColumn("chunk", F.lit(0))
    done = _differenced(large, k, None)
    if n_groups > chunk:
        n = -(-n_groups // chunk)
        left = done.where("left IS NOT NULL").first()
        sums = [x // n for x in left["left"]] if left else [0] * k
        small = groups.where(F.col("bytes") <= least).withColumn(
            "chunk", F.pmod(F.xxhash64("group"), F.lit(n))
        )
        done = done.unionByName(_differenced(small, k, sums))
    return done.where("group IS NOT NULL").select("group", "shard")


def shard(docs: DataFrame, k: int = SHARDS, id_col: str = "doc_id", text: str = "text",
          overhead: int = OVERHEAD, chunk: int = CHUNK) -> DataFrame:
    """Per document: id, size, crc32 of the text, shard and gapless slot in it."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = materialise(
        docs.select(
            F.col(id_col).alias("_id"),
            F.xxhash64(F.col(text).isNull(), body).alias("_text"),
            (F.octet_length(body) + overhead).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
        ),
        "sizes",
    )
    by_text = materialise(
        rows.groupBy("_text").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_n")), "texts"
    )
    total = by_text.agg(F.sum("_bytes")).first()[0] or 0
    share = max(1, total // k)
    # groups above an even share: fewer than k
    wide = by_text.where((F.col("_bytes") > share) & (F.col("_n") > 1)).select(
        "_text", F.ceil(2 * F.col("_bytes") / share).alias("_parts")
    )
    cut = F.pmod(F.xxhash64("_id", "text_crc32"), F.coalesce("_parts", F.lit(1)))
    rows = rows.join(F.broadcast(wide), "_text", "left").select(
        "_id", "size", "text_crc32",
        F.when(F.col("_parts").isNull(), F.col("_text")).otherwise(F.xxhash64("_text", cut))
        .alias("group"),
    )
    groups = materialise(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    sharded = rows.join(assign(groups, k, chunk), "group")
    placed = running_total(sharded, ["shard"], ["_id", "text_crc32", "size"], F.lit(1), "slot")
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")


def op5_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(load(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
