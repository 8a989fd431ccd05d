"""Sharding by Karmarkar-Karp differencing: near-equal bytes for indivisible groups of equal texts."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored

BLOCK_GROUPS = 4096
#: Groups above 1/(LARGE_SHARE * shards) of all bytes are dealt on their own; at most that many exist.
LARGE_SHARE = 64
#: Rows of a shard that one window numbers, on average; a shard has 8 windows at least.
SLOT_ROWS = 100_000


def difference(tuples: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Combine k-tuples of byte counts into one by largest differencing.

    The two tuples of largest spread (greatest minus least sum) are combined, the largest sums of
    one with the smallest of the other, until one is left. Returns its sums and, for each given
    tuple, the lane of the result that each of its places went to.
    """
    k = len(tuples[0])
    heap, nodes = [], []

    def push(sums: np.ndarray, left: int, right: int, order: np.ndarray) -> None:
        nodes.append((left, right, order))
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), len(nodes) - 1, sums))

    for i, t in enumerate(tuples):
        order = np.argsort(-t, kind="stable")
        push(t[order], i, -1, order)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        made = a + b[::-1]
        order = np.argsort(-made, kind="stable")
        push(made[order], i, j, order)
    sums = heap[0][2]
    lanes: list = [None] * len(tuples)
    todo = [(len(nodes) - 1, np.arange(k))]  # a node, and the lane of the result for each of its places
    while todo:
        at, lane = todo.pop()
        left, right, order = nodes[at]
        inner = np.empty(k, dtype=np.int64)
        inner[order] = lane
        if right < 0:
            lanes[left] = inner
        else:
            todo += [(left, inner), (right, inner[::-1])]
    return sums, lanes


def shard_groups(groups: DataFrame, n_shards: int) -> DataFrame:
    """``groups(key binary, bytes long)`` -> ``(key, shard)``, shards of near-equal bytes.

    The few large groups (at most ``n_shards * LARGE_SHARE``) are differenced on the driver; one
    above the mean of what is left has a shard to itself. All others are dealt by hash to blocks of about
    BLOCK_GROUPS. Tasks difference each block but one, starting from the block's share of what the large
    groups left uneven, as one more partial partition whose places are the shards. What that leaves uneven
    is one partial partition too: with the single groups of the block that was held back, it is
    differenced last, on the driver. One block alone is differenced with the large groups at once.
    """
    spark = groups.sparkSession
    n, total = groups.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    is_large = F.col("bytes") * F.lit(n_shards * LARGE_SHARE) > F.lit(total or 0)
    large = sorted(groups.where(is_large).collect(), key=lambda r: (-r.bytes, bytes(r.key)))
    alone, rest = 0, total or 0
    while alone < min(len(large), n_shards - 1) and large[alone].bytes * (n_shards - alone) > rest:
        rest -= large[alone].bytes
        alone += 1
    k, others = n_shards - alone, large[alone:]
    blocks = max(1, -(-(n - len(large)) // BLOCK_GROUPS))
    small = groups.where(~is_large).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    held = sorted(small.where("block = 0").collect(), key=lambda r: (-r.bytes, bytes(r.key)))  # about BLOCK_GROUPS
    own = [(r.key, k + i) for i, r in enumerate(large[:alone])]
    if blocks == 1:
        one, last, dealt = np.zeros(k, np.int64), others + held, None
    else:
        sums, lanes = difference([_single(r.bytes, k) for r in others]) if others else (np.zeros(k, np.int64), [])
        own += [(r.key, int(lane[0])) for r, lane in zip(others, lanes, strict=True)]
        dealt = stored(_deal_blocks(small.where("block > 0"), blocks - 1, sums, max(1, rest - sum(r.bytes for r in others))))
        one = sums.copy()
        for r in dealt.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():
            one[r.shard] += r.bytes
        last = held
    if last:
        lanes = difference([one, *(_single(r.bytes, k) for r in last)])[1]
        shard = np.empty(k, np.int64)
        shard[lanes[0]] = np.arange(k)
        own += [(r.key, int(shard[lane[0]])) for r, lane in zip(last, lanes[1:], strict=True)]
    made = spark.createDataFrame(own, "key binary, shard int")
    return made if dealt is None else dealt.select("key", "shard").unionByName(made)


def _deal_blocks(small: DataFrame, blocks: int, sums: np.ndarray, left: int) -> DataFrame:
    """``(key, bytes, shard)`` of ``small(key, bytes, block)``; a block levels its share, by bytes of ``left``, of ``sums``."""
    k = len(sums)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys, sizes = None, [], []

        def close() -> pa.RecordBatch:
            lanes = difference([(sums * (sum(sizes) / left)).astype(np.int64), *(_single(b, k) for b in sizes)])[1]
            shard = np.empty(k, np.int32)
            shard[lanes[0]] = np.arange(k)
            made = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(shard[[x[0] for x in lanes[1:]]])], ["key", "bytes", "shard"])
            keys.clear()
            sizes.clear()
            return made

        for batch in batches:
            for key, size, own in zip(batch.column("key").to_pylist(), batch.column("bytes").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if own != block and keys:
                    yield close()
                block = own
                keys.append(key)
                sizes.append(size)
        if keys:
            yield close()

    tasks = min(int(small.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks)
    return small.repartition(tasks, "block").sortWithinPartitions("block", "key").mapInArrow(deal, "key binary, bytes long, shard int")


def _single(size: int, k: int) -> np.ndarray:
    return np.r_[size, np.zeros(k - 1, np.int64)]


def shard_documents(docs: DataFrame, n_shards: int = 40, text: str = "text") -> DataFrame:
    """The op7 contract under law ``bytes``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Rows of equal texts stay together (null and empty texts are one group). Slots count rows from 0
    in each shard, by the hash of their ids, then ``doc_id`` (nulls first) and text; repeated rows
    take slots of their own; an empty table has no rows, and a text of any length is one row. No shard is gathered whole: rows are numbered in hashed buckets, and
    buckets start where the ones before them end.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(t, 256)).alias("key"))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    shards = stored(shard_groups(stored(groups), n_shards))
    buckets = max(8, docs.count() // (n_shards * SLOT_ROWS))
    placed = stored(rows.join(shards, "key").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)).cast("int")))
    starts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("shard", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    order = Window.partitionBy("shard", "bucket").orderBy(F.asc_nulls_first("doc_id"), "key")
    numbered = placed.withColumn("at", F.row_number().over(order)).join(starts, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
