"""Shards by fixed virtual slots and a versioned map from slots to shards.

A record's slot is the hash of its id and text modulo a number of slots that never changes, some
thousands. Bytes and rows are aggregated per slot, and a map says which shard each slot belongs to.
Only the map is edited: when shards are added it gives them whole slots of the others, and when
sizes drift it moves as few slots as it takes. Every edit is a new version, written beside the old
ones and never over them, so that readers of an older version go on.

The map has one row for each slot, whatever the data, so it may be planned on the driver and
broadcast. Planning takes the slots by falling size, each to the shard that has least; sizes of
shards then differ by no more than one of the last slots placed. A slot holds 1 / ``SLOTS`` of all
records; a record is never split, nor are rows that repeat both id and text.

Nulls, ties, repeats: a null text has no bytes; a null id hashes as nothing, so the text decides. A
row's size is its text's UTF-8 bytes and 8 more. Rows of equal slot and hash lie side by side in any
order. Planning breaks ties by the smaller number. No rows give no rows, and then slots are dealt out
by number alone. New columns that a given one has the name of get an underscore appended.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogops.llm.registry import free, query, table
from catalogops.plans.durable import durable
from catalogops.plans.ordered import global_position
from catalogops.session import fresh_path

SLOTS = 1 << 13
SHARDS = 24
ROW_BYTES = 8
MAP = "version int, virtual_slot int, shard int"


def slotted(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, place (the record's hash) and virtual_slot of every record."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    place = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    told = records.select("doc_id", (F.octet_length(data) + ROW_BYTES).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), place.alias("place"))
    return told.withColumn("virtual_slot", F.pmod("place", F.lit(slots)).cast("int"))


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """Bytes of every slot; the sums have at most ``slots`` rows."""
    out = np.zeros(slots, np.int64)
    for row in records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).toLocalIterator():
        out[row["virtual_slot"]] = row["bytes"]
    return out


def planned(weights: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each slot, for a first map: the largest slot first, to the shard with the least bytes, then the fewest slots."""
    heap, out = [(0, 0, s) for s in range(shards)], np.zeros(len(weights), np.int64)
    for slot in np.argsort(-weights, kind="stable").tolist():
        size, held, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (size + int(weights[slot]), held + 1, shard))
    return out


def grown(old: np.ndarray, weights: np.ndarray, shards: int) -> np.ndarray:
    """The map with new shards up to ``shards``; slots move only into those.

    Each move takes from the shard with most bytes, for the emptiest new one, the largest slot that is
    no more than the one has over an equal share and the other lacks; where none is, the smallest, as
    long as the giver keeps no less than the taker has.
    """
    out, had = old.copy(), int(old.max(initial=-1)) + 1
    size = np.bincount(out, weights, minlength=shards).astype(np.int64)
    share = size.sum() / shards
    while had < shards:
        taker, giver = had + int(np.argmin(size[had:])), int(np.argmax(size[:had]))
        own = np.flatnonzero((out == giver) & (weights > 0))
        fits = own[weights[own] <= min(size[giver] - share, share - size[taker])]
        if len(fits):
            slot = fits[np.argmax(weights[fits])]
        else:
            own = own[size[giver] - weights[own] >= size[taker] + weights[own]]
            if len(own) == 0 or size[giver] <= share:
                break
            slot = own[np.argmin(weights[own])]
        out[slot] = taker
        size[giver] -= weights[slot]
        size[taker] += weights[slot]
    return out


def rebalanced(old: np.ndarray, weights: np.ndarray, shards: int, slack: float = 0.01) -> np.ndarray:
    """The map with slots moved from the fullest to the emptiest shard, the one that evens the two best.

    It ends once no shard is more than ``slack`` over an equal share, or no move makes the fullest smaller.
    """
    out = old.copy()
    size = np.bincount(out, weights, minlength=shards).astype(np.int64)
    while size.max() > (1 + slack) * size.sum() / shards:
        giver, taker = int(np.argmax(size)), int(np.argmin(size))
        own = np.flatnonzero(out == giver)
        own = own[(weights[own] > 0) & (size[taker] + weights[own] < size[giver])]
        if len(own) == 0:
            break
        slot = own[np.argmin(np.abs((size[giver] - size[taker]) / 2 - weights[own]))]
        out[slot] = taker
        size[giver] -= weights[slot]
        size[taker] += weights[slot]
    return out


class SlotMap:
    """Versions of a slot map in a folder, one folder for each; none is ever written twice."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def store(self, version: int, shards_of: np.ndarray) -> None:
        rows = [(version, slot, int(shard)) for slot, shard in enumerate(shards_of)]
        self.spark.createDataFrame(rows, MAP).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/v{version}")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP).parquet(f"{self.path}/v{version}")

    def shards_of(self, version: int) -> np.ndarray:
        return np.array([r["shard"] for r in self.read(version).orderBy("virtual_slot").collect()], np.int64)


def placed(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """The ``slotted`` records with shard and slot, the place in the shard, gapless from 0.

    Places come from one order over all records, (shard, virtual slot, hash), so a shard is spread
    over as many tasks as its size asks for.
    """
    told = records.join(F.broadcast(mapping.select("virtual_slot", "shard")), "virtual_slot")
    at = durable(global_position(told, ["shard", "virtual_slot", "place", "doc_id"], "at"), "placed")
    first = at.groupBy("shard").agg(F.min("at").alias("first"))
    # One row a shard.
    return at.join(F.broadcast(first), "shard").withColumn("slot", F.col("at") - F.col("first")).drop("at", "first")


def sharded(records: DataFrame, mapping: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The columns of ``records`` and their shard by the map."""
    names = list(records.columns)
    slot, shard = free(["virtual_slot", "shard"], names)
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text")), F.lit(slots)).cast("int")
    own = mapping.select(F.col("virtual_slot").alias(slot), F.col("shard").alias(shard))
    return records.withColumn(slot, place).join(F.broadcast(own), slot).select(*names, shard)


@query("op12_virtual_slots")
def op12_virtual_slots(spark, sf_dir):
    """Shard and place of every document by a map planned on bytes, and by its next version with one shard more."""
    records = durable(slotted(table(spark, sf_dir, "documents")), "slotted")
    weights = slot_bytes(records)
    versions = SlotMap(spark, fresh_path(spark, "slot-map"))
    versions.store(1, planned(weights, SHARDS))
    versions.store(2, grown(versions.shards_of(1), weights, SHARDS + 1))
    after = versions.read(2).select("virtual_slot", F.col("shard").alias("next_shard"))
    return placed(records, versions.read(1)).join(F.broadcast(after), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", F.lit(1).alias("map_version"), "next_shard",
    )
