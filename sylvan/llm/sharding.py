"""Sharding by fixed virtual slots, in DataFrame functions only.

A record's text digest puts it into one of SLOTS virtual slots, so equal texts stay together. Bytes are aggregated per slot, and a versioned map
sends slots to shards: the heaviest slot first, each to the shard with fewest bytes. A text whose copies outweigh HEAVY of an even shard is split: its
records are dealt over all slots by doc_id and digest, and by their number where both are equal; the other texts of its slot stay whole. The map is
stored by version (write_map, read_map). rebalance() edits it for the rows of today: it moves as few slots as bring the
shards within a tolerance, and the new version names the one it came from.

Only per-slot totals (SLOTS rows) and the digests of split texts (shards / HEAVY at most) go to the driver. A row's place in its shard is its place in its slot plus the rows of the shard's earlier slots,
so no task holds a shard.

Null text counts as no bytes. Null doc_ids sort first in their slot. Repeated rows each have a place. Other columns are ignored (assign) or kept
(write_shards: the folders' column is called shard, with underscores after it while the input has a column of that name); an empty table gives an empty result and a map of empty slots.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name

SLOTS = 8_192
HEAVY = 0.5
#: A record's bytes besides its text's.
OVERHEAD = 8
#: Equal rows of a split text that one row of an intermediate step stands for at most.
COPIES = 4_096


@dataclass
class SlotMap:
    """Version of a slot-to-shard map. split: digests of texts whose records are dealt over all slots."""

    shards: int
    shard_of: list[int]
    split: list[int] = field(default_factory=list)
    version: int = 1
    parent: int | None = None
    moved: list[int] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(vars(self))

    @staticmethod
    def from_json(text: str) -> SlotMap:
        return SlotMap(**json.loads(text))


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + OVERHEAD


def _digest() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _slot(slots: int) -> Column:
    return F.pmod(_digest(), F.lit(slots)).cast("int")


def _records(docs: DataFrame, slots: int, split: Iterable[int]) -> DataFrame:
    """doc_id, size, text_crc32, copy (the number of a split text's row among its equals, else 0), virtual_slot."""
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    rows = docs.select("doc_id", record_size(F.col("text")).alias("size"), crc, _digest().alias("digest"))
    plain = F.pmod("digest", F.lit(slots)).cast("int").alias("virtual_slot")
    if not split:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).cast("bigint").alias("copy"), plain)
    heavy = F.col("digest").isin(sorted(split))
    whole = rows.where(~heavy).select("doc_id", "size", "text_crc32", F.lit(0).cast("bigint").alias("copy"), plain)
    names = ["doc_id", "size", "text_crc32", "digest"]
    counted = rows.where(heavy).groupBy(*names).agg(F.count("*").alias("n"))  # equal rows are one row until they are numbered
    parts = counted.select(*names, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / COPIES))).alias("part")).repartition("doc_id", "digest", "part")
    copies = parts.select(*names, F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1)).alias("copy"))
    return whole.unionByName(copies.select("doc_id", "size", "text_crc32", "copy", F.pmod(F.xxhash64("doc_id", "digest", "copy"), F.lit(slots)).cast("int").alias("virtual_slot")))


def _totals(rows: DataFrame, slots: int) -> list[int]:
    out = [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("n")).collect():
        out[r["virtual_slot"]] = r["n"]
    return out


def even_map(totals: list[int], shards: int) -> list[int]:
    """A shard for each slot: heaviest slot first, to the shard with fewest bytes (ties: the lowest)."""
    import heapq

    heap, out = [(0, s) for s in range(shards)], [0] * len(totals)
    for slot in sorted(range(len(totals)), key=lambda i: (-totals[i], i)):
        n, s = heapq.heappop(heap)
        out[slot] = s
        heapq.heappush(heap, (n + totals[slot], s))
    return out


def weigh(docs: DataFrame, shards: int, slots: int) -> tuple[list[int], list[int]]:
    """(bytes of each slot, digests of split texts): one aggregation by slot, and only if a slot is heavy one by text in such slots and another by slot."""
    totals = _totals(_records(docs, slots, ()), slots)
    most = HEAVY * sum(totals) / shards
    heavy, split = [i for i, n in enumerate(totals) if n > most], []
    if heavy:
        texts = docs.where(_slot(slots).isin(heavy)).groupBy(_digest().alias("digest")).agg(F.sum(record_size(F.col("text"))).alias("n"))
        split = sorted(r["digest"] for r in texts.where(F.col("n") > most).collect())
    return _totals(_records(docs, slots, split), slots) if split else totals, split


def build_map(docs: DataFrame, shards: int, slots: int = SLOTS) -> SlotMap:
    """The first version of the map."""
    totals, split = weigh(docs, shards, slots)
    return SlotMap(shards, even_map(totals, shards), split)


def rebalance(docs: DataFrame, old: SlotMap, shards: int | None = None, tolerance: float = 0.02) -> SlotMap:
    """The map edited for the rows of docs, and for another number of shards if one is given: texts that are heavy now are split, and few slots move."""
    totals, split = weigh(docs, shards or old.shards, len(old.shard_of))
    return edited(old, totals, split, shards, tolerance)


def edited(old: SlotMap, totals: list[int], split: list[int] = (), shards: int | None = None, tolerance: float = 0.02) -> SlotMap:
    """An edited map for today's bytes per slot (and another number of shards): slots of shards that are gone move, then slots leave the fullest
    shard for the emptiest while that is over `tolerance` of an even share, the slot that fits best each time."""
    shards = shards or old.shards
    of, moved = list(old.shard_of), set()
    held: list[set[int]] = [set() for _ in range(shards)]
    load = [0] * shards
    for slot, s in enumerate(of):
        if s < shards:
            held[s].add(slot)
            load[s] += totals[slot]

    def put(slot: int, s: int) -> None:
        of[slot] = s
        held[s].add(slot)
        load[s] += totals[slot]
        moved.add(slot)

    for slot in sorted((i for i, s in enumerate(of) if s >= shards), key=lambda i: (-totals[i], i)):
        put(slot, min(range(shards), key=load.__getitem__))
    even = sum(totals) / shards
    while True:
        full, empty = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = (load[full] - load[empty]) / 2
        fits = [i for i in held[full] if 0 < totals[i] <= gap]
        if load[full] - load[empty] <= tolerance * even or not fits:
            break
        slot = max(fits, key=lambda i: (totals[i], -i))
        held[full].discard(slot)
        load[full] -= totals[slot]
        put(slot, empty)
    return SlotMap(shards, of, list(split), old.version + 1, old.version, sorted(i for i in moved if of[i] != old.shard_of[i]))


def write_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Add a version; a version that is there already is an error."""
    spark.range(1, numPartitions=1).select(F.lit(slot_map.to_json()).alias("map")).write.parquet(f"{path}/version={slot_map.version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    rows = spark.read.schema("map string, version int").parquet(path)
    rows = rows.where(F.col("version") == version) if version is not None else rows.orderBy(F.desc("version"))
    return SlotMap.from_json(rows.first()["map"])


def _looked_up(values: list[int], slot: str) -> Column:
    """values[slot]; the list goes into the plan as one literal."""
    return F.get(F.from_json(F.lit(json.dumps(values)), "array<bigint>"), F.col(slot))


def assign(docs: DataFrame, slot_map: SlotMap) -> DataFrame:
    """doc_id, size, text_crc32, shard, virtual_slot, slot (the row's place in its shard, gapless from 0)."""
    slots = len(slot_map.shard_of)
    rows = _records(docs, slots, slot_map.split)
    counts = {r["virtual_slot"]: r["n"] for r in rows.groupBy("virtual_slot").agg(F.count("*").alias("n")).collect()}
    base, at = [0] * slots, [0] * slot_map.shards
    for slot in range(slots):
        s = slot_map.shard_of[slot]
        base[slot], at[s] = at[s], at[s] + counts.get(slot, 0)
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy")) - 1
    placed = rows.withColumn("place", place)
    return placed.select("doc_id", "size", "text_crc32", _looked_up(slot_map.shard_of, "virtual_slot").cast("int").alias("shard"), "virtual_slot", (_looked_up(base, "virtual_slot") + F.col("place")).alias("slot"))


def write_shards(docs: DataFrame, slot_map: SlotMap, path: str) -> str:
    """docs as one folder a shard, under path; a shard's rows come from many tasks. Returns the name of the folders' column."""
    slots, name, own = len(slot_map.shard_of), free_name(docs, "shard"), _digest()
    if slot_map.split:  # equal rows can stand for each other: any number of their own will do
        own = F.when(own.isin(slot_map.split), F.xxhash64("doc_id", own, F.monotonically_increasing_id())).otherwise(own)
    rows = docs.withColumn(name, F.pmod(own, F.lit(slots)).cast("int"))
    rows = rows.withColumn(name, _looked_up(slot_map.shard_of, name).cast("int"))
    rows.repartition(F.col(name), F.pmod(F.xxhash64("doc_id", "text"), F.lit(16))).write.partitionBy(name).parquet(path)
    return name
