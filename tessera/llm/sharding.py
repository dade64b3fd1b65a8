"""Sharding through fixed virtual slots.

A record's slot depends on its id alone and never changes. A small versioned table maps
slots to shards; rebalancing edits that table, so only records of moved slots move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, table

SLOTS = 4096


def slot_of(id_col, slots: int = SLOTS):
    """Slot of an id: the first 32 bits of MD5 of its text form, modulo ``slots``. A null id hashes as ''."""
    h = F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % F.lit(slots)


def slot_sizes(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(slot, n_docs, n_bytes), a row for every slot, unused ones included.

    Null texts count 0 bytes; repeated rows count each time. The partial aggregates hold at
    most ``slots`` rows a task, so the shuffle is bounded whatever the input.
    """
    used = (
        docs.select(slot_of(F.col(f"`{id_col}`"), slots).alias("slot"), F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("bigint").alias("b"))
        .groupBy("slot")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("b").alias("n_bytes"))
    )
    every = docs.sparkSession.range(slots).select(F.col("id").alias("slot"))
    return every.join(used, "slot", "left").select("slot", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))


def initial_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: equal runs of slots."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").alias("slot"), F.floor(F.col("id") * shards / F.lit(slots)).cast("int").alias("shard"))


def rebalanced_map(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of ``current`` over ``shards`` shards, moving no more than it must.

    With target T = ceil(total bytes / shards), a shard keeps its slots in slot order while
    their running bytes stay within T; shards beyond ``shards`` keep none. The other slots are
    laid end to end and dropped into the shards' remaining room, so that a shard ends at most
    one slot above T. Works on the fixed number of slots, never on records.
    """
    spark = current.sparkSession
    now = current.join(sizes.select("slot", "n_bytes"), "slot")
    total = now.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("s"))
    target = total.select(F.ceil(F.col("s") / F.lit(shards)).cast("bigint").alias("t"))
    run = Window.partitionBy("shard").orderBy("slot")
    marked = now.crossJoin(F.broadcast(target)).withColumn("kept", (F.sum("n_bytes").over(run) <= F.col("t")) & (F.col("shard") < shards))
    load = marked.where("kept").groupBy("shard").agg(F.sum("n_bytes").alias("b"))
    room = (
        spark.range(shards).select(F.col("id").cast("int").alias("to_shard"))
        .join(load.withColumnRenamed("shard", "to_shard"), "to_shard", "left")
        .crossJoin(F.broadcast(target))
        .select("to_shard", (F.col("t") - F.coalesce("b", F.lit(0))).alias("room"))
        .withColumn("room_end", F.sum("room").over(Window.orderBy("to_shard")))
        .select("to_shard", (F.col("room_end") - F.col("room")).alias("room_start"), "room_end")
    )
    movers = marked.where(~F.col("kept")).withColumn("pos", F.sum("n_bytes").over(Window.orderBy("shard", "slot")) - F.col("n_bytes"))
    moved = movers.join(F.broadcast(room), (F.col("pos") >= F.col("room_start")) & (F.col("pos") < F.col("room_end")), "left")
    last = F.lit(shards - 1)
    return marked.where("kept").select((F.col("version") + 1).alias("version"), "slot", "shard").unionByName(
        moved.select((F.col("version") + 1).alias("version"), "slot", F.coalesce("to_shard", F.least(F.col("shard"), last)).cast("int").alias("shard"))
    )


class SlotMapStore:
    """Append-only store of map versions: a Parquet table (version, slot, shard) in one folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "slot_map")

    def append(self, version: DataFrame) -> None:
        version.select(F.col("version").cast("int"), F.col("slot").cast("bigint"), F.col("shard").cast("int")).coalesce(1).write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        return self.spark.read.schema("version int, slot bigint, shard int").parquet(self.path)

    def get(self, version: int) -> DataFrame:
        return self.all().where(F.col("version") == version)

    def version(self) -> int:
        """The newest version, 0 of an empty store."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return 0
        return self.all().agg(F.max("version")).first()[0] or 0

    def latest(self) -> DataFrame:
        return self.get(self.version())


def shard_documents(docs: DataFrame, shards: int = 12, grown: int = 16, slots: int = SLOTS, store: SlotMapStore | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, slot, shard_v1, shard_v2) for every row: before and after rebalancing to ``grown`` shards.

    The newest map of ``store`` is edited and the result appended as its next version; an empty
    store, or none, starts with equal runs of slots over ``shards`` shards. A store's maps all
    have its first map's slots, so ``slots`` must be as many.

    Null ids share the slot of '', null texts count no bytes, texts of any length count whole;
    repeated rows stay repeated; an empty table gives no rows; other columns are ignored, and
    documents of equal ids share a slot. Only the slot map, of fixed size, is broadcast.
    """
    store = store or SlotMapStore(docs.sparkSession)
    if not store.version():
        store.append(initial_map(docs.sparkSession, shards, slots))
    now = store.version()
    if store.get(now).count() != slots:
        raise ValueError(f"the store's map doesn't have {slots} slots")
    store.append(rebalanced_map(store.get(now), slot_sizes(docs, slots, id_col, text_col), grown))
    both = store.all().groupBy("slot").agg(F.max(F.when(F.col("version") == now, F.col("shard"))).alias("shard_v1"), F.max(F.when(F.col("version") == now + 1, F.col("shard"))).alias("shard_v2"))
    i = F.col(f"`{id_col}`")
    return docs.select(i.alias("doc_id"), slot_of(i, slots).alias("slot")).join(F.broadcast(both), "slot").select("doc_id", "slot", "shard_v1", "shard_v2")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % 4096 AS slot, coalesce(strlen(text), 0) AS b FROM documents),
s AS (SELECT r.slot, coalesce(sum(d.b), 0)::BIGINT AS n_bytes, (r.slot * 12 // 4096)::INTEGER AS shard FROM (SELECT unnest(range(4096)) AS slot) r LEFT JOIN d USING (slot) GROUP BY r.slot),
t AS (SELECT CAST(ceil(sum(n_bytes) / 16.0) AS BIGINT) AS t FROM s),
k AS (SELECT s.*, t.t, sum(n_bytes) OVER (PARTITION BY shard ORDER BY slot) <= t.t AS kept FROM s, t),
room AS (SELECT q.shard AS to_shard, t.t - coalesce(l.b, 0) AS room FROM (SELECT unnest(range(16)) AS shard) q CROSS JOIN t LEFT JOIN (SELECT shard, sum(n_bytes) AS b FROM k WHERE kept GROUP BY shard) l ON l.shard = q.shard),
rr AS (SELECT to_shard, sum(room) OVER (ORDER BY to_shard) - room AS a, sum(room) OVER (ORDER BY to_shard) AS z FROM room),
mv AS (SELECT slot, shard, sum(n_bytes) OVER (ORDER BY shard, slot) - n_bytes AS pos FROM k WHERE NOT kept),
m AS (SELECT slot, shard AS shard_v1, shard AS shard_v2 FROM k WHERE kept UNION ALL SELECT mv.slot, mv.shard, coalesce(rr.to_shard, mv.shard) FROM mv LEFT JOIN rr ON mv.pos >= rr.a AND mv.pos < rr.z)
SELECT d.doc_id, d.slot, m.shard_v1::INTEGER AS shard_v1, m.shard_v2::INTEGER AS shard_v2 FROM d JOIN m USING (slot)
"""
