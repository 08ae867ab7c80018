"""Sharding over fixed virtual slots, with DataFrame functions alone.

A record hashes into one of ``SLOTS`` slots for ever. Bytes are summed per slot, and a versioned table maps
slots to shards: version 0 deals the slots out in turn, each later version is an edit of the one before
that moves slots from the fullest shards to the emptiest until sizes are near equal. Only slots move; the
table has ``SLOTS`` rows a version at any input size, which is the bound under which it is broadcast.

Defined cases: a null text has no bytes (size 8, checksum 0); a null id hashes like any value; repeated
rows are kept and share a slot; an empty table gives no rows and a map of empty slots. Positions count
from 0 in each shard without gaps: the slot's first position in its shard plus the row's rank in the slot,
so a sort never holds more than one slot.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, stored

SLOTS = 8192


def slotted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``(doc_id, size, text_crc32, virtual_slot)``; the texts themselves are read once and not shuffled."""
    bytes_ = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(bytes_).cast("long") + 8).alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot; at most as many entries as there are slots."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return {r.virtual_slot: (r.b, r.n) for r in found}


def first_map(slots: int, shards: int) -> list[int]:
    """Version 0: slot -> shard in turn."""
    return [k % shards for k in range(slots)]


def rebalanced(before: list[int], sizes: dict[int, tuple[int, int]], shards: int, slack: float = 0.0005) -> list[int]:
    """The next version: an edit of ``before`` for ``shards`` shards.

    A slot whose shard is gone moves first; then, from the fullest shard to the emptiest, the largest slot
    that narrows their gap, until the gap is within ``slack`` of the mean or no slot narrows it.
    """
    weight = lambda s: sizes.get(s, (0, 0))[0]
    now, held, homeless = list(before), [[] for _ in range(shards)], []
    for slot, shard in enumerate(before):
        (held[shard] if shard < shards else homeless).append(slot)
    load = [sum(map(weight, h)) for h in held]
    heap = [(x, k) for k, x in enumerate(load)]
    heapq.heapify(heap)
    for slot in sorted(homeless, key=lambda s: (-weight(s), s)):
        x, k = heapq.heappop(heap)
        now[slot] = k
        held[k].append(slot)
        load[k] = x + weight(slot)
        heapq.heappush(heap, (load[k], k))
    for _ in range(4 * len(before)):
        low, high = min(range(shards), key=lambda k: (load[k], k)), max(range(shards), key=lambda k: (load[k], -k))
        gap = load[high] - load[low]
        if gap <= slack * sum(load) / shards:
            break
        fit = max((s for s in held[high] if 0 < 2 * weight(s) <= gap), key=lambda s: (weight(s), -s), default=None)
        if fit is not None:
            moves = [(fit, high, low)]
        else:  # no slot alone narrows the gap: exchange two
            pairs = {}
            for s in held[low]:
                pairs.setdefault(weight(s), s)
            best = max(
                ((weight(s) - w, s, t) for s in held[high] for w, t in pairs.items() if 0 < 2 * (weight(s) - w) <= gap),
                default=None,
            )
            if best is None:
                break
            moves = [(best[1], high, low), (best[2], low, high)]
        for s, a, b in moves:
            held[a].remove(s)
            held[b].append(s)
            load[a] -= weight(s)
            load[b] += weight(s)
            now[s] = b
    return now


def map_table(spark: SparkSession, versions: list[list[int]], sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """``(version, virtual_slot, shard, bytes, rows, first)``: ``first`` is the slot's first position in its shard."""
    rows = []
    for v, owner in enumerate(versions):
        at: dict[int, int] = {}
        for slot, shard in enumerate(owner):
            b, n = sizes.get(slot, (0, 0))
            rows.append([v, slot, shard, b, n, at.get(shard, 0)])
            at[shard] = at.get(shard, 0) + n
    fields = ("version", "virtual_slot", "shard", "bytes", "rows", "first")
    parsed = F.from_json(F.lit(json.dumps(rows)), "array<array<bigint>>")
    one = spark.range(1).select(F.explode(parsed).alias("r"))
    return one.select(*[F.col("r")[k].cast("int" if k in (0, 1, 2) else "long").alias(f) for k, f in enumerate(fields)])


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """``(doc_id, size, text_crc32, virtual_slot, shard, slot)`` and the path of the stored map."""
    spark = docs.sparkSession
    rows = stored(slotted(docs, doc_id, text, slots), "slotted")
    sizes = slot_sizes(rows)
    zero = first_map(slots, shards)
    path = shared_path(spark, "slot-map")
    map_table(spark, [zero, rebalanced(zero, sizes, shards)], sizes).write.partitionBy("version").parquet(path)
    owner = spark.read.parquet(path).where("version = 1").select("virtual_slot", "shard", "first")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("rank", rank.cast("long")).join(F.broadcast(owner), "virtual_slot")
    return placed.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("rank") - 1).alias("slot")), path
