"""Versioned reads, log replay and optimistic transactions over append-only tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConflictError, NotFoundError, QueryParseError, TransactionTimeout


def snapshot(versions: DataFrame, committed: DataFrame, as_of: int, key: str = "doc_id", version: str = "version", txn: str = "txn_id") -> DataFrame:
    """The newest version of each key at ``as_of`` or before, by a committed transaction; tombstones come as entries.

    ``max_by`` aggregates partially before its shuffle, where a window would sort every version.
    """
    seen = versions.where(F.col(version) <= as_of).join(committed.select(txn), txn, "left_semi")
    best = seen.groupBy(key).agg(F.max_by(F.struct(*[c for c in seen.columns if c != key]), version).alias("v"))
    return best.select(key, "v.*")


def history(versions: DataFrame, doc_id, key: str = "doc_id", version: str = "version") -> DataFrame:
    return versions.where(F.col(key) == doc_id).orderBy(version)


def gc(versions: DataFrame, oldest: int, key: str = "doc_id", version: str = "version") -> DataFrame:
    """Versions that a snapshot at ``oldest`` or later can read."""
    keep = versions.where(F.col(version) <= oldest).groupBy(key).agg(F.max(version).alias("_keep"))
    return versions.join(keep, key, "left").where((F.col(version) > oldest) | (F.col(version) == F.col("_keep"))).drop("_keep")


def replay(log: DataFrame, key: str = "doc_id", seq: str = "seq", op: str = "op") -> DataFrame:
    """State after a log: each key's last operation, deleted keys left out."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), seq).alias("v"))
    return last.where(F.col(f"v.{op}") != "delete").select(key, "v.*")


def conflicts(writes: DataFrame, committed: DataFrame, txn: str = "txn_id", key: str = "doc_id") -> DataFrame:
    """Transactions of ``writes`` that wrote a key which another transaction of ``committed`` wrote.

    A key's committed transactions are folded to the least and the greatest: one of them differs
    from a writer if any does. So the join meets a row a key, however hot.
    """
    others = committed.where(F.col(txn).isNotNull()).groupBy(key).agg(F.min(txn).alias("_low"), F.max(txn).alias("_high"))
    mine = writes.select(key, txn).distinct()
    return mine.join(others, key).where((F.col(txn) != F.col("_low")) | (F.col(txn) != F.col("_high"))).select(txn).distinct()


#: Kinds of log entries; the first three change a document.
LOG_KINDS = ("insert", "update", "delete", "create_collection", "drop_collection", "create_index", "drop_index", "txn_begin", "txn_commit", "txn_abort", "checkpoint")


def checksum(log: DataFrame, data: str = "data") -> Column:
    """CRC-32 of an entry's number, kind, key and data, of which a missing one counts as empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("seq", "op", "collection", "doc_id", "txn_id", data) if c in log.columns]
    return F.crc32(F.concat_ws("\x1f", *parts).cast("binary"))


def log_append(spark: SparkSession, path: str, entries: DataFrame, data: str = "data") -> int:
    """Append entries, in order of their ``seq``, to a log folder with numbers that go on from its last and checksums; returns the last.

    Entries are dealt to ranges of ``seq``, written so that a lost executor cannot change the
    ranges, and numbered by the ranges' sizes, not in one task.
    """
    p, pending = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}/_pending-{uuid.uuid4().hex}"))
    fs, last = p.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    if fs.exists(p):
        last = spark.read.parquet(path).agg(F.max("seq")).first()[0] or 0
    entries.repartitionByRange("seq").withColumn("_part", F.spark_partition_id()).write.parquet(pending.toString())
    ranged = spark.read.parquet(pending.toString())
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = {}, last
    for k in sorted(sizes):
        before[k], at = at, at + sizes[k]
    if not before:
        fs.delete(pending, True)
        return last
    base = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for kv in before.items() for x in kv]), F.col("_part").cast("bigint"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("seq"))
    rows = ranged.withColumn("seq", (base + place).cast("bigint")).drop("_part")
    rows.withColumn("crc", checksum(rows, data)).write.mode("append").parquet(path)
    fs.delete(pending, True)
    return at


def log_read(spark: SparkSession, path: str, data: str = "data") -> DataFrame:
    """Entries of a log folder whose checksums hold; others are passed over."""
    log = spark.read.parquet(path)
    return log.where(F.col("crc") == checksum(log, data)).drop("crc")


def recover(log: DataFrame) -> DataFrame:
    """Documents after a log of all kinds of entries, by (collection, doc_id).

    Entries of a transaction count only if it has a commit entry, and a document of a collection
    only after the collection was last dropped.
    """
    done = log.where("op = 'txn_commit'").select("txn_id").distinct()
    ops = log.where(F.col("op").isin(*LOG_KINDS[:3]))
    ops = ops.where("txn_id IS NULL").unionByName(ops.where("txn_id IS NOT NULL").join(done, "txn_id", "left_semi"))
    drops = log.where("op = 'drop_collection'").groupBy("collection").agg(F.max("seq").alias("_dropped"))
    ops = ops.join(drops, "collection", "left").where("_dropped IS NULL OR seq > _dropped").drop("_dropped")
    last = ops.groupBy("collection", "doc_id").agg(F.max_by(F.struct(*[c for c in ops.columns if c not in ("collection", "doc_id")]), "seq").alias("v"))
    return last.where("v.op <> 'delete'").select("collection", "doc_id", "v.*")


def put_version(versions: DataFrame, changes: DataFrame, txn: int, key: str = "doc_id", version: str = "version") -> DataFrame:
    """``versions`` with one more version of each key of ``changes``, written by ``txn``: the number after the key's newest, 1 of a new key.

    A change of null data is a tombstone. A key that ``changes`` repeats gets one version, of its
    greatest row.
    """
    cols = [c for c in versions.columns if c not in (key, version, "txn_id")]
    new = changes.groupBy(key).agg(F.max(F.struct(*cols)).alias("v")).select(key, "v.*")
    newest = versions.join(new.select(key), key, "left_semi").groupBy(key).agg(F.max(version).alias("_newest"))
    new = new.join(newest, key, "left").withColumn(version, F.coalesce("_newest", F.lit(0)) + 1).withColumn("txn_id", F.lit(txn)).drop("_newest")
    return versions.unionByName(new.select(*[F.col(c).cast(versions.schema[c].dataType) for c in versions.columns]))


def entries_after(oplog: DataFrame, ts: int, ts_col: str = "ts") -> DataFrame:
    return oplog.where(F.col(ts_col) > ts).orderBy(ts_col)


def latest(oplog: DataFrame, n: int = 1, ts_col: str = "ts") -> DataFrame:
    return oplog.orderBy(F.desc(ts_col)).limit(n)


def oplog_append(oplog: DataFrame, new: DataFrame, entries: int, ts_col: str = "ts") -> DataFrame:
    """The newest ``entries`` of a log after ``new`` entries, numbered from 1 in their batch, have their numbers go on from its last."""
    top = oplog.agg(F.coalesce(F.max(ts_col), F.lit(0)).alias("_top"))
    return capped(oplog.unionByName(new.crossJoin(F.broadcast(top)).withColumn(ts_col, F.col(ts_col) + F.col("_top")).drop("_top")), entries, ts_col)


def capped(oplog: DataFrame, entries: int, ts_col: str = "ts") -> DataFrame:
    """The newest ``entries`` of a log with dense timestamps."""
    top = oplog.agg(F.max(ts_col).alias("_top"))
    return oplog.crossJoin(F.broadcast(top)).where(F.col(ts_col) > F.col("_top") - entries).drop("_top")


#: Names that a transaction may begin under; every one of them reads the snapshot of its begin.
ISOLATION = ("read_uncommitted", "read_committed", "repeatable_read", "serializable", "snapshot")


class TransactionManager:
    """Buffers operations and applies a transaction as one batch at commit; the first committer wins."""

    def __init__(self, timeout_s: float = 30.0):
        self.timeout_s, self.open, self.committed, self._next = timeout_s, {}, {}, 1

    def begin(self, isolation: str = "snapshot") -> int:
        import time

        if isolation not in ISOLATION:
            raise QueryParseError(f"no isolation level {isolation}")
        n, self._next = self._next, self._next + 1
        self.open[n] = {"ops": [], "at": time.monotonic(), "after": set(self.committed), "isolation": isolation}
        return n

    def add(self, txn: int, op: str, key, data=None) -> None:
        import time

        t = self._of(txn)
        if time.monotonic() - t["at"] > self.timeout_s:
            self.abort(txn)
            raise TransactionTimeout(f"transaction {txn} timed out")
        t["ops"].append((op, key, data))

    def commit(self, txn: int) -> list[tuple]:
        t = self._of(txn)
        keys = {k for _, k, _ in t["ops"]}
        for n, written in self.committed.items():
            if n not in t["after"] and keys & written:
                self.abort(txn)
                raise ConflictError(f"transaction {txn} wrote what {n} has committed")
        self.committed[txn] = keys
        return self.open.pop(txn)["ops"]

    def abort(self, txn: int) -> None:
        self._of(txn)
        del self.open[txn]

    def _of(self, txn: int) -> dict:
        if txn not in self.open:
            raise NotFoundError(f"no open transaction {txn}")
        return self.open[txn]
