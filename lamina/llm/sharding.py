"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots that never change; bytes are summed per slot, and a versioned map gives each
slot a shard. Rebalancing edits the map, so only the rows of the slots it moves change place.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables, scratch

SLOTS = 4096


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def slot_loads(df: DataFrame, slots: int = SLOTS) -> dict[int, tuple[int, int]]:
    """Bytes and rows per slot, from columns vslot and size: at most `slots` rows reach the driver."""
    got = df.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return {s: (0, 0) for s in range(slots)} | {r.vslot: (r.bytes, r["rows"]) for r in got}


def assign(loads: dict[int, int], shards: int) -> dict[int, int]:
    """First map: the heaviest slot first, each to the lightest shard."""
    heap = [(0, 0, s) for s in range(shards)]
    out = {}
    for slot in sorted(loads, key=lambda s: (-loads[s], s)):
        size, n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (size + loads[slot], n + 1, shard))
    return out


def rebalance(old: dict[int, int], loads: dict[int, int], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """Edit a map until shards differ by no more than `tolerance` of their mean, or no move helps.

    A move takes one slot from the heaviest shard to the lightest: the largest that brings neither past the mean, so a
    shard either gives or receives. Slots of shards that no longer exist are placed first; new shards start empty.
    """
    out = dict(old)
    held, total = defaultdict(list), [0] * shards
    for slot, shard in old.items():
        if shard < shards:
            held[shard].append(slot)
            total[shard] += loads.get(slot, 0)
    for slot in sorted((s for s, shard in old.items() if shard >= shards), key=lambda s: (-loads.get(s, 0), s)):
        to = min(range(shards), key=lambda s: (total[s], s))
        out[slot] = to
        held[to].append(slot)
        total[to] += loads.get(slot, 0)
    while True:
        high, low = max(range(shards), key=lambda s: (total[s], -s)), min(range(shards), key=lambda s: (total[s], s))
        gap = total[high] - total[low]
        room = min(total[high] - sum(total) / shards, sum(total) / shards - total[low])
        fits = [s for s in held[high] if 0 < loads.get(s, 0) <= room]
        if gap <= tolerance * sum(total) / shards or not fits:
            return out
        slot = max(fits, key=lambda s: (loads[s], -s))
        held[high].remove(slot)
        held[low].append(slot)
        out[slot] = low
        total[high] -= loads[slot]
        total[low] += loads[slot]


class SlotMaps:
    """Versions of a slot-to-shard map, each a small table <path>/version=N that is never changed once written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = lambda s: fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(folder) if "=" in s.getPath().getName() and done(s)) if fs.exists(folder) else []

    def save(self, slots: dict[int, int], version: int) -> DataFrame:
        rows = self.spark.createDataFrame(sorted(slots.items()), "vslot int, shard int")
        rows.coalesce(1).write.parquet(f"{self.path}/version={version}")
        return self.load(version)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema("vslot int, shard int").parquet(f"{self.path}/version={version}")

    def fitted(self, loads: dict[int, int], shards: int, tolerance: float = 0.001) -> dict[int, int]:
        """The map for these loads: the last version, edited by rebalance() and saved as the next if that changed it; without one, a first map."""
        known = self.versions()
        if not known:
            slots = assign(loads, shards)
            self.save(slots, 0)
            return slots
        old = {r.vslot: r.shard for r in self.load(known[-1]).collect()}  # a row a slot
        if set(old) != set(loads):
            raise ValueError(f"{self.path} maps {len(old)} slots, not {len(loads)}: their number is fixed")
        slots = rebalance(old, loads, shards, tolerance)
        if slots != old:
            self.save(slots, known[-1] + 1)
        return slots


def _heavy(rows: DataFrame, loads: dict[int, tuple[int, int]]) -> list[int]:
    """Keys with more rows than two slots should have. At most half as many as there are slots, and looked for only where a slot is that full."""
    bound = 2 * sum(n for _, n in loads.values()) / len(loads)
    full = [s for s, (_, n) in loads.items() if n > max(bound, 64)]
    if not full:
        return []
    return [r.key for r in rows.where(F.col("vslot").isin(full)).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bound).select("key").collect()]


def _slot(key: Column, heavy: list[int], slots: int) -> Column:
    """A key's slot; rows of a heavy key, which no slot could hold evenly, are dealt over all slots."""
    own = F.pmod(key, F.lit(slots)).cast("int")
    return F.when(key.isin(heavy), F.pmod(F.monotonically_increasing_id(), F.lit(slots)).cast("int")).otherwise(own) if heavy else own


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS, maps: SlotMaps | None = None) -> DataFrame:
    """Every row of docs (doc_id, text, any others) with its vslot and shard, by law `bytes`: shards of near equal size.

    Texts aren't shuffled: a narrow pass sums bytes per slot, and the map (one row a slot) is broadcast. With `maps` the
    last version of the map is edited, so that only rows of the slots it moves change place. Null doc_id and null text
    hash as nulls; an empty table gives an empty result; rows that agree in both doc_id and text share a slot unless they
    are more than two slots should hold. Columns of docs called vslot or shard, in any letter case, give way to the
    operator's; all others stay as they are. A text's length matters only to its slot's load.
    """
    maps = maps or SlotMaps(docs.sparkSession, scratch(docs.sparkSession, "slotmap"))
    key = F.xxhash64("doc_id", "text")
    narrow = docs.select(key.alias("key"), F.pmod(key, F.lit(slots)).cast("int").alias("vslot"), record_bytes(F.col("text")).alias("size"))
    loads = slot_loads(narrow, slots)
    if heavy := _heavy(narrow, loads):  # dealt evenly, they weigh the same on every slot
        light = slot_loads(narrow.where(~F.col("key").isin(heavy)), slots)
        rest = (sum(b for b, _ in loads.values()) - sum(b for b, _ in light.values())) // slots
        loads = {s: (b + rest, n) for s, (b, n) in light.items()}
    placed = maps.fitted({s: b for s, (b, _) in loads.items()}, shards)
    table = docs.sparkSession.createDataFrame(sorted(placed.items()), "vslot int, shard int")
    own = [F.col(f"d.`{c}`") for c in docs.columns if c.lower() not in ("vslot", "shard")]
    kept = docs.select(*[c for c in docs.columns if c.lower() not in ("vslot", "shard")], _slot(key, heavy, slots).alias("vslot")).alias("d")
    return kept.join(F.broadcast(table).alias("m"), F.col("d.vslot") == F.col("m.vslot")).select(*own, "d.vslot", "m.shard")


def shard_table(docs: DataFrame, shards: int = 8, slots: int = SLOTS, maps: SlotMaps | None = None) -> DataFrame:
    """One narrow row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot.

    slot is the row's place in its shard, gapless from 0: rows are ranked within their virtual slot (thousands of small
    sorts, none per shard) and start after the rows of the shard's earlier virtual slots. Ties (repeated rows) take
    successive places, and those of a key that fills more than two slots are dealt over all. Null text counts as empty
    (size 1, CRC 0), null doc_id sorts first, an empty table gives no rows; further columns are ignored. With `maps` the
    last version of the map is edited.
    """
    maps = maps or SlotMaps(docs.sparkSession, scratch(docs.sparkSession, "slotmap"))
    text, key = F.coalesce("text", F.lit("")), F.xxhash64("doc_id", "text")
    own = F.pmod(key, F.lit(slots)).cast("int")
    with Tables(docs.sparkSession) as t:
        first = t.write(docs.select("doc_id", record_bytes(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"), own.alias("vslot")), "keyed")
        loads = slot_loads(first, slots)
        heavy = _heavy(first, loads)
        narrow = t.keep(first.withColumn("vslot", _slot(F.col("key"), heavy, slots)).drop("key"), "records")
        loads = slot_loads(narrow, slots) if heavy else loads
    placed = maps.fitted({s: b for s, (b, _) in loads.items()}, shards)
    seen, starts = defaultdict(int), []
    for slot in range(slots):
        starts.append((slot, placed[slot], seen[placed[slot]]))
        seen[placed[slot]] += loads[slot][1]
    table = docs.sparkSession.createDataFrame(starts, "vslot int, shard int, start long")
    rank = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return narrow.withColumn("rank", rank).join(F.broadcast(table), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )
