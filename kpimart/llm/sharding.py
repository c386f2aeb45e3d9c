"""Sharding by fixed virtual slots (native).

Records are hashed into a fixed number of virtual slots (4,096 by default).
Bytes and rows are aggregated per slot, and a slot-to-shard map is kept as a
versioned table: version 0 deals the slots out in turn, and every rebalance
writes a new version that edits the one before it. A slot stays on its shard
while the shard has room under the mean load, and moves to the least loaded
shard otherwise, so an edit moves little. Records follow their slot; only the
map (one row per slot) changes hands.

Rows that agree in id, size and CRC are counted and dealt out over the slots,
one after the other from the slot of their hash on, so that no slot has more
than its part of a row's copies.

Edge cases: a null text has 8 bytes and a null CRC; null ids hash by text; a
repeated row's copies lie in the slots after its first one's; an empty table
gives an empty result; columns that the operator does not name are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOTS = 4096
RECORD_OVERHEAD = 8


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus the fixed overhead."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(RECORD_OVERHEAD)


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null for null."""
    return F.crc32(text.cast("binary"))


def with_slots(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, virtual_slot`` of every row."""
    sized = docs.select(
        F.col(key).alias(key), record_size(F.col(text)).alias("size"), text_crc32(F.col(text)).alias("text_crc32")
    )
    # copies are counted before the shuffle, and parted before they are rows again
    parts = F.least("copies", F.lit(slots).cast("long"))
    each = F.expr("copies div parts") + F.when(F.col("part") < F.col("copies") % F.col("parts"), 1).otherwise(0)
    first = F.xxhash64(F.col(key), F.col("text_crc32"))
    dealt = (
        sized.groupBy(key, "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("parts", parts)
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumn("virtual_slot", F.pmod(F.pmod(first, F.lit(slots)) + F.col("part"), F.lit(slots)).cast("int"))
        .select(key, "size", "text_crc32", "virtual_slot", each.cast("long").alias("copies"))
        .repartition("virtual_slot")
    )
    return dealt.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")


def slot_loads(slotted: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty slots included (``slots`` rows)."""
    loads = slotted.groupBy("virtual_slot").agg(
        F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows")
    )
    every = slotted.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(loads, "virtual_slot", "left").select(
        "virtual_slot",
        F.coalesce("slot_bytes", F.lit(0)).alias("slot_bytes"),
        F.coalesce("slot_rows", F.lit(0)).alias("slot_rows"),
    )


class SlotMap:
    """A versioned slot-to-shard map: one write-once Parquet folder a version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _folder(self, version: int) -> str:
        return f"{self.path}/version={version:06d}"

    def write(self, version: int, rows: DataFrame) -> DataFrame:
        """Write one version; an existing version is never replaced."""
        rows.select("virtual_slot", "shard").coalesce(1).write.mode("errorifexists").parquet(self._folder(version))
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int").parquet(self._folder(version))

    def start(self, slots: int, shards: int) -> DataFrame:
        """Version 0: slots dealt out in turn."""
        rows = self.spark.range(slots).select(
            F.col("id").cast("int").alias("virtual_slot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard")
        )
        return self.write(0, rows)


def rebalance(current: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of a map: ``virtual_slot, shard`` for ``shards`` shards.

    The slots are taken from the largest down. One stays on its shard if the
    shard's load remains within the mean, and goes to the least loaded shard
    otherwise; empty slots stay. The fold runs over one array of all slots,
    whose length is the fixed slot count.
    """
    slots = current.join(loads, "virtual_slot").agg(
        F.sort_array(
            F.collect_list(F.struct((-F.col("slot_bytes")).alias("neg"), F.col("virtual_slot").alias("slot"), "shard"))
        ).alias("items"),
        (F.sum("slot_bytes") / F.lit(shards)).alias("mean"),
    )
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("out")
    )

    def place(acc: Column, item: Column) -> Column:
        size = -item["neg"]
        home = item["shard"]
        stays = (home < shards) & ((size == 0) | (F.get(acc["load"], home) + size <= F.col("mean")))
        least = (F.array_position(acc["load"], F.array_min(acc["load"])) - 1).cast("int")
        to = F.when(stays, home).otherwise(least)
        # an array of one element binds the choice, so that it is made once
        return F.transform(
            F.array(to),
            lambda t: F.struct(
                F.transform(acc["load"], lambda v, i: F.when(i == t, v + size).otherwise(v)).alias("load"),
                F.concat(acc["out"], F.array(t)).alias("out"),
            ),
        )[0]

    placed = slots.select("items", F.aggregate("items", start, place, lambda acc: acc["out"]).alias("out"))
    rows = placed.select(F.explode(F.arrays_zip("items", "out")).alias("z"))
    return rows.select(F.col("z.items.slot").alias("virtual_slot"), F.col("z.out").alias("shard"))


def assign(slotted: DataFrame, loads: DataFrame, slot_map: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every record with its shard and its gapless place in the shard.

    The place is the number of rows in the shard's earlier slots (from the
    small table of slots) plus the record's rank in its own slot, so that no
    task sorts a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(loads, "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("first_place")
    )
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(key, "text_crc32", "size"))
    # the map has one row per slot: its size is the fixed slot count
    return (
        slotted.withColumn("rank", rank)
        .join(F.broadcast(starts), "virtual_slot")
        .withColumn("place", F.col("first_place") + F.col("rank") - 1)
        .drop("first_place", "rank")
    )


def shard_by_slots(docs: DataFrame, shards: int, map_path: str, slots: int = SLOTS) -> DataFrame:
    """Shard ``docs``: aggregate the slots, write map versions 0 (as dealt out)
    and 1 (rebalanced to the measured bytes) under ``map_path``, and return
    ``doc_id, size, text_crc32, virtual_slot, shard, place``."""
    store = SlotMap(docs.sparkSession, map_path)
    slotted = with_slots(docs, slots)
    loads_path = f"{store.path}/loads"
    # an exchange, so that the one writing task only gets the row of each slot
    slot_loads(slotted, slots).repartition(1).write.mode("errorifexists").parquet(loads_path)
    loads = docs.sparkSession.read.parquet(loads_path)
    balanced = store.write(1, rebalance(store.start(slots, shards), loads, shards))
    return assign(slotted, loads, balanced)
