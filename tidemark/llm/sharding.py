"""Sharding by fixed virtual slots.

Every record is hashed into one of ``n_slots`` virtual slots, a number that never changes. Only the
slots are placed: a versioned map says which shard holds each slot, and rebalancing or growing edits
that map, so that a record moves only if its slot does. The map has ``n_slots`` rows whatever the
size of the table; this bounds what the driver holds and what is broadcast.

Law: ``bytes``. Slots are placed by their summed bytes, largest first on the lightest shard.

Defined cases: a null text has size 16 (its overhead) and checksum 0, as the empty text; rows with a
null id are dealt over the slots by their place in the input, and so are rows of an id that repeats so often that its
bytes are over an eighth of a mean slot's; other rows of one id share a slot and get different places in it; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import folder, stage

N_SLOTS = 4096
OVERHEAD = 16
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long, rows long, first_place long"


@dataclass(frozen=True)
class Slot:
    virtual_slot: int
    shard: int
    bytes: int = 0
    rows: int = 0


@dataclass(frozen=True)
class SlotMap:
    """Version of the slot-to-shard map; ``slots`` has one entry for each virtual slot."""

    version: int
    n_shards: int
    slots: tuple[Slot, ...]

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for s in self.slots:
            out[s.shard] += s.bytes
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """The map as rows; first_place is the number of rows of its shard's earlier slots."""
        seen, rows = [0] * self.n_shards, []
        for s in self.slots:
            rows.append((self.version, s.virtual_slot, s.shard, s.bytes, s.rows, seen[s.shard]))
            seen[s.shard] += s.rows
        return spark.createDataFrame(rows, MAP_SCHEMA)


def first_map(loads: dict[int, tuple[int, int]], n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """Version 1: the slots in order of falling bytes, each to the shard that is lightest then."""
    heap = [(0, k) for k in range(n_shards)]
    shard = [0] * n_slots
    for v in sorted(range(n_slots), key=lambda v: (-loads.get(v, (0, 0))[0], v)):
        load, k = heapq.heappop(heap)
        shard[v] = k
        heapq.heappush(heap, (load + loads.get(v, (0, 0))[0], k))
    return SlotMap(1, n_shards, tuple(Slot(v, shard[v], *loads.get(v, (0, 0))) for v in range(n_slots)))


def rebalance(old: SlotMap, loads: dict[int, tuple[int, int]], tolerance: float = 0.01, n_shards: int | None = None) -> SlotMap:
    """The next version, after new loads or with more shards: as few slots move as the tolerance allows.

    Again and again the heaviest shard gives the lightest one its largest slot that narrows the gap,
    until no shard is over the mean by more than the tolerance or no move helps.
    """
    n = n_shards or old.n_shards
    slots = [replace(s, bytes=loads.get(s.virtual_slot, (0, 0))[0], rows=loads.get(s.virtual_slot, (0, 0))[1]) for s in old.slots]
    held: list[set[int]] = [set() for _ in range(n)]
    sums = [0] * n
    for i, s in enumerate(slots):
        held[s.shard].add(i)
        sums[s.shard] += s.bytes
    mean = sum(sums) / n
    for _ in range(len(slots) * 4):
        heavy, light = max(range(n), key=lambda k: (sums[k], -k)), min(range(n), key=lambda k: (sums[k], k))
        gap = sums[heavy] - sums[light]
        if sums[heavy] <= mean * (1 + tolerance) and sums[light] >= mean * (1 - tolerance):
            break
        best = max((i for i in held[heavy] if 0 < slots[i].bytes < gap), key=lambda i: (min(slots[i].bytes, gap - slots[i].bytes), -i), default=None)
        if best is None:
            break
        held[heavy].remove(best)
        held[light].add(best)
        sums[heavy] -= slots[best].bytes
        sums[light] += slots[best].bytes
        slots[best] = replace(slots[best], shard=light)
    return SlotMap(old.version + 1, n, tuple(slots))


def save_map(spark: SparkSession, m: SlotMap, path: str) -> None:
    """Add the version to the map table; earlier versions stay."""
    m.frame(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map table, the latest if none is named."""
    maps = spark.read.schema(MAP_SCHEMA).parquet(path)
    return maps.where(F.col("version") == (version if version is not None else maps.agg(F.max("version")).first()[0]))


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def in_slots(docs: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32 and virtual_slot of every record; an id that would crowd its slot is dealt over all."""
    crc = F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))
    rows = docs.select(F.col(id_col), text_size(F.col(text_col)).alias("size"), crc.alias("text_crc32"), F.monotonically_increasing_id().alias("_row"))
    rows = stage(rows, "records")
    crowd = stage(crowding(rows, n_slots, id_col), "crowding")
    rows = rows.join(F.broadcast(crowd), F.col(id_col) == F.col("_crowd"), "left")
    apart = F.col(id_col).isNull() | F.col("_crowd").isNotNull()
    key = F.when(apart, F.xxhash64("_row")).otherwise(F.xxhash64(F.col(id_col).cast("string")))
    return rows.withColumn("virtual_slot", F.pmod(key, F.lit(n_slots)).cast("int")).select(id_col, "size", "text_crc32", "virtual_slot")


def crowding(rows: DataFrame, n_slots: int, id_col: str = "doc_id", share: int = 8) -> DataFrame:
    """The repeated ids (_crowd) with more than 1 / (share * n_slots) of all bytes: fewer than share * n_slots."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    each = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_crowd")).agg(F.sum("size").alias("_b"), F.count("*").alias("_n")).where("_n > 1")
    return each.where(F.col("_b") * (share * n_slots) > total).select("_crowd")


def slot_loads(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows by slot: at most n_slots rows reach the driver."""
    return {r[0]: (r[1], r[2]) for r in records.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()}


def place(records: DataFrame, slot_map: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Shard and place in the shard (gapless from 0) of every record.

    The rows of a slot are numbered within it; the map has how many rows its shard's earlier slots
    hold. So no task sorts a whole shard.
    """
    within = Window.partitionBy("virtual_slot").orderBy(F.col(id_col), F.col("text_crc32"))
    m = F.broadcast(slot_map.select("virtual_slot", "shard", "first_place"))
    return (
        records.withColumn("_n", F.row_number().over(within) - 1)
        .join(m, "virtual_slot")
        .withColumn("slot", F.col("first_place") + F.col("_n"))
        .drop("_n", "first_place")
    )


def shard_documents(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Place all documents; the map's first version is stored at map_path (in the shared folder if None)."""
    spark = docs.sparkSession
    records = in_slots(docs, n_slots)
    path = map_path or folder(spark, "slot-map")
    save_map(spark, first_map(slot_loads(records), n_shards, n_slots), path)
    return place(records, load_map(spark, path))


def op1(docs: DataFrame) -> DataFrame:
    return shard_documents(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
