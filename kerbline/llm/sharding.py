"""Sharding by fixed virtual slots.

Records hash into thousands of slots. Bytes are summed per slot, and a small versioned map says which shard
holds which slot. Rebalancing edits that map: only moved slots change place, and no record is hashed anew.
The law kept is ``bytes``: the map is built from the slots' sums, so shards come out near equal in bytes.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.llm.common import literal_table

SLOTS = 4096
ROW_BYTES = 8


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (none for null) and a fixed part for the record itself."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


@dataclass
class SlotMap:
    """Which shard holds each slot. ``version`` rises with each edit; ``moved`` lists the slots of the last."""

    shards: int
    shard_of: dict[int, int]
    version: int = 1
    moved: list[int] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        """``version, shards, slot, shard``: one row per slot in use, at most ``SLOTS``."""
        rows = [(self.version, self.shards, s, k) for s, k in sorted(self.shard_of.items())]
        return literal_table(spark, rows, "version int, shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, folder: str) -> None:
        """Add this version to the folder of versions; earlier ones stay readable."""
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{folder}/version={version}").collect()
        return SlotMap(rows[0]["shards"], {r["virtual_slot"]: r["shard"] for r in rows}, version)


def first_map(sizes: dict[int, int], shards: int) -> SlotMap:
    """Largest slots first, each to the lightest shard."""
    heap = [(0, k) for k in range(shards)]
    shard_of = {}
    for slot, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, k = heapq.heappop(heap)
        shard_of[slot] = k
        heapq.heappush(heap, (load + size, k))
    return SlotMap(shards, shard_of)


def rebalanced(old: SlotMap, sizes: dict[int, int], shards: int) -> SlotMap:
    """The next version, for new sizes or another number of shards, moving few slots.

    Slots of dropped shards and new slots are placed first. Then shards above their even share give up their
    largest slots that fit, to the lightest shard, while that lowers the higher of the two loads.
    """
    shard_of = {s: k for s, k in old.shard_of.items() if k < shards and s in sizes}
    load = [0] * shards
    for s, k in shard_of.items():
        load[k] += sizes[s]
    for s in sorted(sizes.keys() - shard_of.keys(), key=lambda s: (-sizes[s], s)):
        k = min(range(shards), key=lambda k: (load[k], k))
        shard_of[s] = k
        load[k] += sizes[s]
    share = sum(load) / shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for s in sorted(shard_of, key=lambda s: (-sizes[s], s)):
        held[shard_of[s]].append(s)
    for k in sorted(range(shards), key=lambda k: (-load[k], k)):
        for s in held[k]:
            to = min(range(shards), key=lambda j: (load[j], j))
            if load[k] - sizes[s] >= share and load[to] + sizes[s] < load[k]:
                shard_of[s] = to
                load[k] -= sizes[s]
                load[to] += sizes[s]
    return SlotMap(shards, shard_of, old.version + 1, [s for s in shard_of if old.shard_of.get(s) != shard_of[s]])


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot``. The hash covers id and text, so a text that many rows
    repeat spreads over all slots; only rows alike in both share one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", record_bytes(F.col("text")).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.pmod(F.xxhash64("doc_id", text), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_sizes(records: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Bytes and rows per slot; reaches the driver, at most one row per slot however many records."""
    rows = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    return {r["virtual_slot"]: r["bytes"] for r in rows}, {r["virtual_slot"]: r["n"] for r in rows}


def placed(records: DataFrame, slot_map: SlotMap, counts: dict[int, int]) -> DataFrame:
    """Adds ``shard`` and ``slot``, the record's place in its shard, without gaps from 0.

    Places are numbered within virtual slots (a few thousandths of the rows per task) and start where the
    shard's earlier slots end.
    """
    start: dict[int, int] = {}
    filled = [0] * slot_map.shards
    for s, k in sorted(slot_map.shard_of.items()):
        start[s] = filled[k]
        filled[k] += counts[s]
    spark = records.sparkSession
    where = literal_table(spark, [(s, k, start[s]) for s, k in slot_map.shard_of.items()], "virtual_slot int, shard int, start long")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    numbered = records.withColumn("place", place)
    return numbered.join(where, "virtual_slot").select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place") - 1).alias("slot"), "virtual_slot")


def shard_documents(docs: DataFrame, shards: int, slots: int = SLOTS, map_folder: str | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, virtual_slot`` for documents (doc_id, text).

    A null text has the size of an empty one. Null or repeated ids are rows like any other. No rows: an
    empty table. ``map_folder``: where to keep the map's versions.
    """
    records = slotted(docs, slots)
    sizes, counts = slot_sizes(records)
    slot_map = first_map(sizes, shards)
    if map_folder:
        slot_map.save(docs.sparkSession, map_folder)
    return placed(records, slot_map, counts).withColumn("law", F.lit("bytes"))


def write_shards(docs: DataFrame, slot_map: SlotMap, folder: str, slots: int = SLOTS) -> None:
    """Write the rows themselves, one folder per shard; a shard's slots are written by several tasks."""
    spark = docs.sparkSession
    d = docs.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit(""))), F.lit(slots)).cast("int"))
    d = d.join(slot_map.table(spark).select("virtual_slot", "shard"), "virtual_slot")
    d.repartition("virtual_slot").write.partitionBy("shard").mode("overwrite").parquet(folder)
