"""Sharding by fixed virtual slots.

A record hashes into one of `slots` slots, a number that never changes. A versioned map gives each slot its shard; the map is
edited, slot by slot, when shards are to be rebalanced by their bytes or when a shard is added. It is stored as a table to
which each edit appends a version.

Scale: texts are read once, for sizes and checksums; the slots' sums (a fixed number of rows) reach the driver, where the
map is edited. Rows that are alike are counted before they are shuffled, and places within a slot are counted in salted
groups of about `group_rows` kinds of rows, so neither a shard nor a slot nor a repeated row meets in one task.

Cases: null text has no bytes (size 1, crc32 0). The hash takes id, checksum and size, so rows that share an id, also the null
id, spread over slots; rows alike in all three share one. An empty table gives an empty result with a map in rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.session import cut

SLOTS, RUN = 4096, 1 << 20


class SlotMap:
    """Versions of a slot-to-shard map. Version 1 deals slots in rounds; an edit appends a version."""

    def __init__(self, shards: int, slots: int = SLOTS):
        self.versions = [np.arange(slots) % shards]

    @property
    def current(self) -> np.ndarray:
        return self.versions[-1]

    def rebalance(self, load: np.ndarray, shards: int, most_moves: int | None = None) -> int:
        """Move slots from the heaviest to the lightest shard while that narrows their gap. Returns the number of moves."""
        at = self.current.copy()
        sums, moves = np.bincount(at, load, minlength=shards).astype(np.int64), 0
        while most_moves is None or moves < most_moves:
            hi, lo = int(sums.argmax()), int(sums.argmin())
            gap = sums[hi] - sums[lo]
            own = np.nonzero((at == hi) & (load > 0) & (load < gap))[0]
            if not len(own):
                break
            slot = own[np.abs(2 * load[own] - gap).argmin()]
            at[slot], moves = lo, moves + 1
            sums[hi] -= load[slot]
            sums[lo] += load[slot]
        self.versions.append(at)
        return moves

    def grow(self, shards: int, load: np.ndarray) -> None:
        """One more shard: slots move only into it, from the heaviest shard each time, up to its even share."""
        at = self.current.copy()
        sums = np.bincount(at, load, minlength=shards + 1).astype(np.int64)
        for _ in range(len(at)):
            hi = int(sums[:shards].argmax())
            own = np.nonzero((at == hi) & (load > 0) & (sums[shards] + load <= sums[hi]))[0]
            if not len(own) or sums[shards] * (shards + 1) >= sums.sum():
                break
            slot = own[load[own].argmin()]
            at[slot] = shards
            sums[hi] -= load[slot]
            sums[shards] += load[slot]
        self.versions.append(at)

    def frame(self, spark: SparkSession, after: int = 0) -> DataFrame:
        """The versions beyond `after` as rows."""
        rows = [(v + 1, slot, int(shard)) for v, at in enumerate(self.versions) if v >= after for slot, shard in enumerate(at)]
        return spark.createDataFrame(rows, "version int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Append the versions that the table at `path` lacks; what it holds is never written again."""
        held = spark._jvm.org.apache.hadoop.fs.Path(path)
        known = 0
        if held.getFileSystem(spark._jsc.hadoopConfiguration()).exists(held):
            known = spark.read.parquet(path).agg(F.max("version")).first()[0] or 0
        if known < len(self.versions):
            self.frame(spark, known).coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SlotMap:
        got = spark.read.parquet(path).orderBy("version", "virtual_slot").toPandas()
        out = cls.__new__(cls)
        out.versions = [part.shard.to_numpy() for _, part in got.groupby("version")]
        return out


def measure(docs: DataFrame, *, id_col="doc_id", text_col="text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot, copies): every kind of row with its number."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    slim = slim.withColumn("virtual_slot", F.pmod(F.xxhash64(id_col, "text_crc32", "size"), F.lit(slots)).cast("int"))
    return cut(slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("copies")))


def loads(measured: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, rows) of every slot."""
    load, count = np.zeros(slots, dtype=np.int64), np.zeros(slots, dtype=np.int64)
    for r in measured.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("b"), F.sum("copies").alias("n")).collect():
        load[r.virtual_slot], count[r.virtual_slot] = r.b, r.n
    return load, count


def place(measured: DataFrame, slot_map: SlotMap, count: np.ndarray, *, group_rows: int = 50_000) -> DataFrame:
    """A row for every record of `measured`: its shard by the map's newest version and its slot there, gapless from 0."""
    spark, at, kind = measured.sparkSession, slot_map.current, measured.columns[:3]
    base = np.zeros(len(at), dtype=np.int64)
    for s in np.unique(at):
        own = np.nonzero(at == s)[0]
        base[own] = np.cumsum(count[own]) - count[own]
    plan = spark.createDataFrame([(i, int(at[i]), int(base[i])) for i in range(len(at))], "virtual_slot int, shard int, base long")
    salts = max(1, -(-int(count.sum()) // (group_rows * len(at))))
    rows = measured.withColumn("salt", F.pmod(F.xxhash64(F.lit(salts), *kind), F.lit(salts)).cast("int"))
    group = ["virtual_slot", "salt"]
    within = F.sum("copies").over(Window.partitionBy(*group).orderBy(*kind)) - F.col("copies")
    sums = rows.groupBy(*group).agg(F.sum("copies").alias("n"))
    before = sums.select(*group, (F.sum("n").over(Window.partitionBy("virtual_slot").orderBy("salt")) - F.col("n")).alias("before"))
    # the plan has one row a slot
    out = rows.withColumn("within", within).join(before, group).join(F.broadcast(plan), "virtual_slot")
    first = out.select(*kind, "virtual_slot", "shard", (F.col("base") + F.col("before") + F.col("within")).alias("first"), "copies")
    # copies in runs, so that no array holds more than RUN of them
    runs = first.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long"))))
    slot = F.explode(F.sequence(F.col("first") + F.col("run"), F.col("first") + F.least("copies", F.col("run") + RUN) - 1))
    return runs.select(*kind, "virtual_slot", "shard", slot.alias("slot"))


def shard(docs: DataFrame, shards: int = 16, *, id_col="doc_id", text_col="text", slots: int = SLOTS, slot_map: SlotMap | None = None, path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """(rows, map): every row's size, checksum, virtual slot, shard and slot in the shard. Without a map, slots are dealt in
    rounds and rebalanced by bytes; a given map is followed as it is, grown or not. With a `path` the map's versions are
    appended to the table there, and rows are placed by what is read back."""
    spark = docs.sparkSession
    measured = measure(docs, id_col=id_col, text_col=text_col, slots=slots if slot_map is None else len(slot_map.current))
    if slot_map is None:
        slot_map = SlotMap(shards, slots)
        slot_map.rebalance(loads(measured, slots)[0], shards)
    if path is not None:
        slot_map.save(spark, path)
        slot_map = SlotMap.load(spark, path)
    return place(measured, slot_map, loads(measured, len(slot_map.current))[1]), slot_map
