"""Sharding by fixed virtual slots.

Each record is hashed into one of thousands of slots; bytes are added up per slot; a versioned map says which shard has
which slot. Only the map (a row per slot, so of bounded size) decides and only it changes when shards are rebalanced:
records never change slots. Law of the map built here: `bytes` - shards are near equal in bytes.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import written

SLOTS = 8192
SHARDS = 24
LAW = "bytes"


@dataclass
class SlotMap:
    """shard_of[slot]; each edit makes a new version."""

    shard_of: list[int]
    n_shards: int
    version: int = 1
    moved: list[int] = field(default_factory=list)

    @classmethod
    def build(cls, sizes: dict[int, int], n_shards: int, slots: int = SLOTS) -> SlotMap:
        """Largest slot first, each to the shard that has fewest bytes (ties: the lower shard). Empty slots are dealt out
        in turn."""
        shard_of = [s % n_shards for s in range(slots)]
        heap = [(0, k) for k in range(n_shards)]
        for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
            load, k = heapq.heappop(heap)
            shard_of[slot] = k
            heapq.heappush(heap, (load + sizes[slot], k))
        return cls(shard_of, n_shards)

    @classmethod
    def dealt(cls, n_shards: int, slots: int = SLOTS) -> SlotMap:
        """The map before anything is stored: slots in turn."""
        return cls([s % n_shards for s in range(slots)], n_shards)

    @classmethod
    def load(cls, table: DataFrame) -> SlotMap:
        """The latest version in a stored table of maps (a row per slot and version)."""
        last = table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == last).orderBy("virtual_slot").collect()
        return cls([r.shard for r in rows], max(r.shard for r in rows) + 1, last)

    def rebalance(self, sizes: dict[int, int], n_shards: int) -> SlotMap:
        """The next version for n_shards: slots of shards that go are moved first, then slots move from the fullest shard
        to the emptiest while that narrows their gap. Other slots stay."""
        shard_of = list(self.shard_of)
        load = [0] * max(n_shards, self.n_shards)
        own: dict[int, list[int]] = {k: [] for k in range(len(load))}
        for slot in sorted(range(len(shard_of)), key=lambda s: (sizes.get(s, 0), s)):
            own[shard_of[slot]].append(slot)
            load[shard_of[slot]] += sizes.get(slot, 0)
        moved = []

        def move(slot: int, a: int, b: int) -> None:
            own[a].remove(slot)
            own[b].append(slot)
            load[a] -= sizes.get(slot, 0)
            load[b] += sizes.get(slot, 0)
            shard_of[slot] = b
            moved.append(slot)

        live = range(n_shards)
        for gone in range(n_shards, self.n_shards):
            for slot in own[gone][::-1]:
                move(slot, gone, min(live, key=lambda k: (load[k], k)))
        for _ in range(len(shard_of)):
            a, b = max(live, key=lambda k: (load[k], -k)), min(live, key=lambda k: (load[k], k))
            fits = [s for s in own[a] if 0 < sizes.get(s, 0) < load[a] - load[b]]
            if not fits:
                break
            half = (load[a] - load[b]) / 2
            move(min(fits, key=lambda s: (abs(sizes.get(s, 0) - half), s)), a, b)
        return SlotMap(shard_of, n_shards, self.version + 1, moved)

    def table(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType())])
        return spark.createDataFrame([(self.version, s, k) for s, k in enumerate(self.shard_of)], schema)


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32, virtual_slot of each row. Null text has no bytes. A slot is decided
    by doc_id and the text's checksum, so repeated ids with different texts spread."""
    text = F.coalesce("text", F.lit(""))
    crc = F.crc32(text.cast("binary"))
    return docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"), crc.alias("text_crc32"), F.pmod(F.xxhash64(F.col("doc_id"), crc), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_sizes(sized: DataFrame) -> dict[int, tuple[int, int]]:
    """slot -> (bytes, rows), to the driver: at most one row per slot."""
    return {r[0]: (r[1], r[2]) for r in sized.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()}


def shard(docs: DataFrame, n_shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of each row of docs.

    slot is the row's place in its shard, gapless from 0: the places of the shard's virtual slots follow one another, and
    inside a virtual slot rows are ordered by (doc_id, text_crc32, size). Numbering runs per virtual slot, never per shard.
    The stored map starts as slots dealt in turn (version 1) and is edited by rebalance() for the measured bytes (version 2), which
    is stored too and decides. grown_shard is null under the law `bytes`. The contract's groups are equal texts: copies have ids
    of their own and so may be in different slots, as bytes alone decide. Null ids are hashed like any others. Other columns are
    ignored, whatever their names; a very long text is one row of its size. Empty tables give empty tables; repeated rows get places of their own.
    """
    spark = docs.sparkSession
    sized = measured(docs, slots)
    sizes = slot_sizes(sized)
    by_bytes = {s: b for s, (b, _) in sizes.items()}
    first = written(SlotMap.dealt(n_shards, slots).table(spark), "slot-map")
    placed = SlotMap.load(first).rebalance(by_bytes, n_shards)
    stored = written(placed.table(spark), "slot-map")
    offset, filled = {}, [0] * n_shards
    for s in range(slots):
        k = placed.shard_of[s]
        offset[s] = filled[k]
        filled[k] += sizes.get(s, (0, 0))[1]
    places = spark.createDataFrame([(s, o) for s, o in offset.items()], "virtual_slot int, _offset bigint")
    named = stored.join(F.broadcast(places), "virtual_slot")  # both sides: one row per slot
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = sized.withColumn("_at", F.row_number().over(order) - 1)
    return numbered.join(F.broadcast(named), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("_offset") + F.col("_at")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version")
    )
