"""Sharding through fixed virtual slots, with DataFrame functions only.

Every record hashes to one of ``VIRTUAL_SLOTS`` slots for good, and so does every further copy of a record, by its number among them. Bytes and rows are summed by slot; a
versioned map says which shard holds a slot. Version 0 deals the slots out in turn. ``rebalance``
edits a map: shards above the mean give slots up, the lightest take them, then single moves and swaps
between the heaviest and the lightest narrow the gap. Only slots are moved, never single records, and
the map (4,096 slots of 16 cells, whatever the data) is all that the driver ever holds or that is broadcast.

The law of ``query`` is ``bytes``: shards' sizes are near equal. A record's hash takes its doc_id and
its text's checksum, so that one doc_id with many texts spreads as well. Null text has 0 bytes and
checksum 0; null doc_ids hash like any value; copies of a row are numbered, so that no slot must hold them all;
an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm import storage

SHARDS = 24
VIRTUAL_SLOTS = 4096
#: Cells that a slot's records lie in, by their number in the written table, so that copies of one record spread too.
CELLS = 16
#: Tables up to this size in memory are broadcast.
BROADCAST_BYTES = 64 << 20


def records(docs: DataFrame, virtual_slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(virtual_slots)).cast("int"))


def rebalance(current: Sequence[int], weight: Sequence[int], shards: int, rounds: int = 2000) -> list[int]:
    """An edited slot-to-shard map whose shards' weights are near equal."""
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(current):
        held[shard if shard < shards else slot % shards].append(slot)
    load = [sum(weight[s] for s in slots) for slots in held]
    mean, pool = sum(load) / shards, []
    for k in range(shards):
        for slot in sorted(held[k], key=lambda s: -weight[s]):
            if weight[slot] and load[k] - weight[slot] >= mean:
                held[k].remove(slot)
                load[k] -= weight[slot]
                pool.append(slot)
        if load[k] > mean and (some := [s for s in held[k] if weight[s]]) and len(some) > 1:
            slot = min(some, key=lambda s: weight[s])
            held[k].remove(slot)
            load[k] -= weight[slot]
            pool.append(slot)
    queue = [(w, k) for k, w in enumerate(load)]
    heapq.heapify(queue)
    for slot in sorted(pool, key=lambda s: (-weight[s], s)):
        w, k = heapq.heappop(queue)
        held[k].append(slot)
        load[k] = w + weight[slot]
        heapq.heappush(queue, (load[k], k))
    stuck: set[int] = set()
    for _ in range(rounds):
        # A shard whose one slot is heavier than the mean can't be helped; the others still can.
        able = [k for k in range(shards) if k not in stuck]
        if len(able) < 2:
            break
        high, low = max(able, key=lambda k: load[k]), min(able, key=lambda k: load[k])
        gap = load[high] - load[low]
        # What moves from the heaviest should come to half the gap: one slot, or one against another.
        best = min(((abs(gap - 2 * (weight[a] - (weight[b] if b is not None else 0))), a, b) for a in held[high] for b in [None, *held[low]]), key=lambda x: x[0], default=(gap, None, None))
        if best[0] >= gap:
            stuck.add(high)
            continue
        _, a, b = best
        held[high].remove(a)
        held[low].append(a)
        shift = weight[a]
        if b is not None:
            held[low].remove(b)
            held[high].append(b)
            shift -= weight[b]
        load[high] -= shift
        load[low] += shift
        if gap - abs(gap - 2 * shift) <= mean * 1e-5:
            break
    out = [0] * len(current)
    for shard, slots in enumerate(held):
        for slot in slots:
            out[slot] = shard
    return out


def write_map(spark: SparkSession, path: str, version: int, shards: Sequence[int]) -> bool:
    """Add a version to the stored map, whole or not at all; a version that is there is left as it is (False)."""
    return storage.publish_text(spark, f"{path}/version-{version}", json.dumps(list(shards)))


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """virtual_slot and shard as of a version."""
    shards = json.loads(storage.read_texts(spark, path)[f"version-{version}"])
    return spark.createDataFrame(list(enumerate(shards)), "virtual_slot int, shard int")


def numbered_copies(rows: DataFrame, virtual_slots: int) -> DataFrame:
    """The written rows (.., row), copies of one (doc_id, text_crc32) moved to slots by their number among them.

    Copies are numbered within cells, and cells of one record begin where those before them end, so that a
    record with any number of copies is no one task's work.
    """
    keyed = rows.withColumn("cell", F.pmod("row", F.lit(CELLS)).cast("int"))
    cells = keyed.groupBy("doc_id", "text_crc32", "cell").agg(F.count(F.lit(1)).alias("n"))
    again = cells.groupBy(F.col("doc_id").alias("k_doc"), F.col("text_crc32").alias("k_crc")).agg(F.sum("n").alias("all")).where(F.col("all") > 1).drop("all")
    again, again_path = storage.materialise(again, "shard-copies")
    if not again.limit(1).count():
        return rows
    small = storage.fits(again, again_path, BROADCAST_BYTES)
    known = F.broadcast(again) if small else again
    same = lambda d: d["doc_id"].eqNullSafe(known["k_doc"]) & (d["text_crc32"] == known["k_crc"])
    before = Window.partitionBy("doc_id", "text_crc32").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.join(known, same(cells), "left_semi").select(F.col("doc_id").alias("s_doc"), F.col("text_crc32").alias("s_crc"), F.col("cell").alias("s_cell"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = F.broadcast(starts) if small else starts
    in_cell = Window.partitionBy("doc_id", "text_crc32", "cell").orderBy("row")
    copies = keyed.join(known, same(keyed), "left_semi").withColumn("number", F.row_number().over(in_cell) - 1)
    placed = copies.join(starts, copies["doc_id"].eqNullSafe(F.col("s_doc")) & (F.col("text_crc32") == F.col("s_crc")) & (F.col("cell") == F.col("s_cell"))).withColumn("number", F.col("start") + F.col("number"))
    moved = F.pmod(F.xxhash64("doc_id", "text_crc32", "number"), F.lit(virtual_slots)).cast("int")
    placed = placed.withColumn("virtual_slot", F.when(F.col("number") == 0, F.col("virtual_slot")).otherwise(moved))
    out, _ = storage.materialise(rows.join(known, same(rows), "left_anti").unionByName(placed.select(*rows.columns)), "shard-records")
    return out


def shard(docs: DataFrame, map_path: str, shards: int = SHARDS, virtual_slots: int = VIRTUAL_SLOTS, by: str = "bytes") -> DataFrame:
    """Every record with its virtual slot, shard and place in the shard; writes map versions 0 and 1.

    ``by`` is what shards get near equal amounts of: ``bytes`` or ``rows``.
    """
    spark = docs.sparkSession
    rows, _ = storage.materialise(records(docs, virtual_slots).withColumn("row", F.monotonically_increasing_id()), "shard-records")
    rows = numbered_copies(rows, virtual_slots)
    rows = rows.withColumn("cell", F.pmod("row", F.lit(CELLS)).cast("int"))
    cells, _ = storage.materialise(rows.groupBy("virtual_slot", "cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "slot-sums")
    slots = cells.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    weight = [0] * virtual_slots
    for r in slots.select("virtual_slot", by).collect():  # at most ``virtual_slots`` rows
        weight[r[0]] = r[1]
    first = [k % shards for k in range(virtual_slots)]
    write_map(spark, map_path, 0, first)
    write_map(spark, map_path, 1, rebalance(first, weight, shards))
    # Where a cell's records begin in their shard: a window over the map (CELLS rows a slot), not over the records.
    order = Window.partitionBy("shard").orderBy("virtual_slot", "cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = read_map(spark, map_path, 1).join(cells, "virtual_slot").select("virtual_slot", "cell", "shard", F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("ahead"))
    in_cell = Window.partitionBy("virtual_slot", "cell").orderBy("row")
    return rows.join(F.broadcast(placed), ["virtual_slot", "cell"]).withColumn("slot", F.col("ahead") + F.row_number().over(in_cell) - 1).drop("ahead", "cell", "row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents in 24 shards of near equal bytes."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), storage.new_path(spark, "slot-map"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
