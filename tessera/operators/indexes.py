"""Key indexes on disk: sorted for ranges, hashed for equality; unique and sparse; under names.

An index is a table of keys and document ids. A sorted one is written in ranges of the key, so
that Parquet's statistics leave few row groups to read; a hashed one in folders by a hash of the
key, of which a lookup reads one. Entries come in numbered generations; a removal is a row of its
own that hides an id's entries of earlier generations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DuplicateKeyError, NotFoundError, QueryParseError
from ..sources import scratch
from .routing import unique_violations

HASH_BUCKETS = 64


class KeyIndex:
    """One index: ``fields`` of a collection to the ids of its documents."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.meta = spark, path, scratch.load(spark, f"{path}/meta.json")
        self.fields, self.kind = self.meta["fields"], self.meta["kind"]
        self.columns = list(dict.fromkeys([*self.fields, self.meta["id"]]))

    @classmethod
    def create(cls, df: DataFrame, path: str, fields: list[str], kind: str = "btree", unique: bool = False, sparse: bool = False, id_col: str = "_id", buckets: int = HASH_BUCKETS) -> KeyIndex:
        if kind not in ("btree", "hash"):
            raise QueryParseError(f"no index is of kind {kind}")
        types = {f: df.schema[f].dataType.simpleString() for f in [*fields, id_col]}
        scratch.save(df.sparkSession, f"{path}/meta.json", {"fields": fields, "kind": kind, "unique": unique, "sparse": sparse, "id": id_col, "types": types, "buckets": buckets})
        index = cls(df.sparkSession, path)
        try:
            index.insert(df)
        except DuplicateKeyError:
            scratch.delete(df.sparkSession, path)
            raise
        return index

    def _generations(self, of: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in scratch.children(self.spark, f"{self.path}/{of}"))

    def _bucket(self, *keys: Column) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.meta["buckets"])).cast("int")

    def _entries(self) -> DataFrame:
        kind = ", ".join(f"`{n}` {t}" for n, t in self.meta["types"].items()) + ", gen int" + (", bucket int" if self.kind == "hash" else "")
        if not self._generations("entries"):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.path}/entries")

    def _live(self, rows: DataFrame) -> DataFrame:
        """Entries that no later removal hides."""
        if self._generations("removed"):
            gone = self.spark.read.schema(f"_gone {self.meta['types'][self.meta['id']]}, gen int").parquet(f"{self.path}/removed").groupBy("_gone").agg(F.max("gen").alias("_until"))
            rows = rows.join(gone, rows[self.meta["id"]] == gone["_gone"], "left").where(F.col("_until").isNull() | (F.col("gen") > F.col("_until"))).drop("_gone", "_until")
        return rows

    def _indexed(self, df: DataFrame) -> DataFrame:
        """The rows that the index takes: with ``sparse``, those with any key field."""
        rows = df.select(*self.columns)
        return rows.where(reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in self.fields])) if self.meta["sparse"] else rows

    def insert(self, df: DataFrame) -> None:
        """Add the documents' keys as a new generation; of a unique index only if none is there or comes twice."""
        rows = self._indexed(df)
        gen = max([0, *self._generations("entries"), *self._generations("removed")]) + 1
        if self.meta["unique"]:
            bad = unique_violations(rows, self.fields, out="_n").limit(1).first()
            if bad is None and gen > 1:
                old = self._live(self._entries()).select(F.struct(*self.fields).alias("k"))
                bad = rows.select(F.struct(*self.fields).alias("_k")).join(old, F.col("_k").eqNullSafe(F.col("k")), "left_semi").limit(1).first()
            if bad is not None:
                raise DuplicateKeyError(f"duplicate key {bad.asDict(True)}")
        to = f"{self.path}/entries/gen={gen}"
        if self.kind == "btree":
            rows.repartitionByRange(*self.fields).sortWithinPartitions(*self.fields).write.parquet(to)
        else:
            rows.withColumn("bucket", self._bucket(*map(F.col, self.fields))).repartition("bucket").write.partitionBy("bucket").parquet(to)

    def remove(self, ids: DataFrame) -> None:
        gen = max([0, *self._generations("entries"), *self._generations("removed")]) + 1
        ids.select(F.col(ids.columns[0]).cast(self.meta["types"][self.meta["id"]]).alias("_gone")).distinct().write.parquet(f"{self.path}/removed/gen={gen}")

    def _ids(self, rows: DataFrame) -> DataFrame:
        return self._live(rows).select(*self.columns)

    def lookup(self, *key) -> DataFrame:
        """Keys and ids of one key, or of all keys that begin with the given values of a sorted index."""
        if self.kind == "hash" and len(key) != len(self.fields):
            raise QueryParseError("a hash index is asked for whole keys")
        rows = self._entries()
        for f, v in zip(self.fields, key):
            rows = rows.where(F.col(f).eqNullSafe(F.lit(v)) if v is None else F.col(f) == F.lit(v))
        if self.kind == "hash":
            given = [F.lit(v).cast(self.meta["types"][f]) for f, v in zip(self.fields, key)]
            rows = rows.where(F.col("bucket") == self.spark.range(1).select(self._bucket(*given).alias("b")).first()["b"])
        return self._ids(rows)

    def range(self, low=None, high=None) -> DataFrame:
        """Keys and ids with the first field from ``low`` on and below ``high``, in order of the key."""
        if self.kind == "hash":
            raise QueryParseError("a hash index has no order")
        rows, f = self._entries(), F.col(self.fields[0])
        rows = rows if low is None else rows.where(f >= F.lit(low))
        rows = rows if high is None else rows.where(f < F.lit(high))
        return self._ids(rows).orderBy(*self.fields, self.meta["id"])

    def count(self) -> int:
        return self._live(self._entries()).count()


class KeyIndexes:
    """Named key indexes of collections under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def create_index(self, df: DataFrame, collection: str, name: str, fields: list[str], **kw) -> KeyIndex:
        at = f"{self.path}/{collection}/{name}"
        if scratch.exists(self.spark, f"{at}/meta.json"):
            raise DuplicateKeyError(f"index {collection}.{name} is there already")
        return KeyIndex.create(df, at, fields, **kw)

    def get(self, collection: str, name: str) -> KeyIndex:
        if not scratch.exists(self.spark, f"{self.path}/{collection}/{name}/meta.json"):
            raise NotFoundError(f"no index {collection}.{name}")
        return KeyIndex(self.spark, f"{self.path}/{collection}/{name}")

    def drop_index(self, collection: str, name: str) -> None:
        self.get(collection, name)
        scratch.delete(self.spark, f"{self.path}/{collection}/{name}")

    def list_indexes(self, collection: str) -> list[str]:
        return scratch.children(self.spark, f"{self.path}/{collection}")

    def index_documents(self, collection: str, df: DataFrame) -> None:
        """Add documents to every index of a collection; none takes them if a unique one would break."""
        all_ = [self.get(collection, n) for n in self.list_indexes(collection)]
        for i in sorted(all_, key=lambda i: not i.meta["unique"]):
            i.insert(df)

    def unindex_documents(self, collection: str, ids: DataFrame) -> None:
        for n in self.list_indexes(collection):
            self.get(collection, n).remove(ids)

    def stats(self, collection: str) -> dict[str, dict]:
        return {n: {"kind": i.kind, "fields": i.fields, "entries": i.count()} for n in self.list_indexes(collection) for i in [self.get(collection, n)]}
