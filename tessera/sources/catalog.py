"""Databases and collections over files: a collection is a folder of immutable Parquet parts.

What a collection consists of is said by its newest head: a small JSON file that names its parts
with their counts and holds its settings and indexes. A write makes new parts and then a head of
the next number, which can be created once only; readers of an older head are not disturbed, and
of two writers one starts again. A driver or an executor lost on the way leaves files that no
head names, which ``vacuum`` removes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CapacityError, ConflictError, DuplicateKeyError, NotFoundError, ValidationError
from ..operators import find as finds
from ..operators.routing import unique_violations
from ..operators.validate import Field, Schema, errors
from ..plans.filters import compile_filter
from ..plans.pipeline import aggregate
from ..plans.updates import apply_update, delete_many, parse_update

#: Times that a writer who lost to another starts again.
TRIES = 20


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole text, by a rename that never overwrites; False where it is there already."""
    fs, target = _fs(spark, path), _path(spark, path)
    if fs.exists(target):
        return False
    draft = _path(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, none)
    except Py4JJavaError:
        fs.delete(draft, False)
        if fs.exists(target):
            return False
        raise
    return True


def _schema(spec: dict | None) -> Schema | None:
    if spec is None:
        return None
    fields = {n: Field(**{**f, "nested": _schema(f.get("nested"))}) for n, f in spec["fields"].items()}
    return Schema(fields, spec["allow_additional_fields"])


class Collection:
    """Rows with ``_id``, ``_version`` and optional ``_expires_at`` beside their fields."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    # --- heads

    def _heads(self) -> list[int]:
        fs, p = _fs(self.spark, self.path), _path(self.spark, f"{self.path}/heads")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def exists(self) -> bool:
        return bool(self._heads())

    def head(self) -> tuple[int, dict]:
        numbers = self._heads()
        if not numbers:
            raise NotFoundError(f"no collection at {self.path}")
        return numbers[-1], json.loads(read_text(self.spark, f"{self.path}/heads/{numbers[-1]:012d}.json"))

    def create(self, schema: Schema | None = None, cap: int | None = None, cap_bytes: int | None = None) -> Collection:
        """A new, empty collection; settings of one that exists are replaced, its rows stay."""
        settings = {"schema": None if schema is None else asdict(schema), "cap": cap, "cap_bytes": cap_bytes}
        if self.exists():
            return self._commit(lambda h: h | settings)
        write_once(self.spark, f"{self.path}/heads/{1:012d}.json", json.dumps({"parts": [], "indexes": {}} | settings))
        return self

    def _commit(self, change: Callable[[dict], dict | None], expected: int | None = None) -> Collection:
        """Write the next head as ``change`` makes it of the newest, again if another writer was first; None changes nothing.

        With ``expected``, a head that came in between is a conflict instead.
        """
        for _ in range(TRIES):
            n, old = self.head()
            if expected is not None and n != expected:
                raise ConflictError(f"{self.path} has changed since version {expected}")
            new = change(old)
            if new is None or write_once(self.spark, f"{self.path}/heads/{n + 1:012d}.json", json.dumps(new)):
                return self
        raise ConflictError(f"{self.path}: other writers were first {TRIES} times")

    # --- reading

    def _read(self, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], "_id string, _version bigint")
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{p['name']}" for p in parts])

    def df(self, version: int | None = None) -> DataFrame:
        """The rows of the newest head, or of an older one, without those that have expired."""
        head = self.head()[1] if version is None else json.loads(read_text(self.spark, f"{self.path}/heads/{version:012d}.json"))
        out = self._read(head["parts"])
        return out.where(F.col("_expires_at").isNull() | (F.col("_expires_at") >= F.current_timestamp())) if "_expires_at" in out.columns else out

    def find(self, query: dict | None = None, **kw) -> DataFrame:
        return finds.find(self.df(), query, **kw)

    def find_by_id(self, doc_id: str):
        return finds.find_one(self.df(), {"_id": doc_id})

    def count(self, query: dict | None = None) -> int:
        """Documents that match; without a filter or expiry, the sum of what the head says."""
        if not query:
            parts = self.head()[1]["parts"]
            if not any(p["expires"] for p in parts):
                return sum(p["count"] for p in parts)
        return finds.count(self.df(), query)

    def aggregate(self, stages: list[dict], collections: dict[str, DataFrame] | None = None, sink=None) -> DataFrame:
        return aggregate(self.df(), stages, collections, sink)

    # --- writing

    def _write(self, df: DataFrame) -> dict:
        """Write a part; its entry for a head. Values that change by run, such as ids, are fixed by this."""
        name = f"part-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        folder = _path(self.spark, f"{self.path}/{name}")
        return {"name": name, "count": self._read([{"name": name}]).count(), "bytes": _fs(self.spark, self.path).getContentSummary(folder).getLength(), "expires": "_expires_at" in df.columns}

    def _with(self, kept: list[dict], part: dict) -> list[dict]:
        """Parts with one more, unless that is empty."""
        if part["count"]:
            return [*kept, part]
        self._remove(part)
        return kept

    def _remove(self, part: dict) -> None:
        _fs(self.spark, self.path).delete(_path(self.spark, f"{self.path}/{part['name']}"), True)

    def _check(self, head: dict, rows: DataFrame) -> None:
        schema = _schema(head["schema"])
        if schema is not None:
            bad = rows.where(errors(rows, schema).isNotNull()).limit(1).select(errors(rows, schema)).first()
            if bad is not None:
                raise ValidationError(bad[0])

    def _check_unique(self, head: dict, kept: list[dict], new: dict) -> None:
        """No key of a unique index is twice in the new part, or in it and a part that stays."""
        for name, index in head["indexes"].items():
            if not index["unique"]:
                continue
            rows, fields = self._read([new]), index["fields"]
            if not set(fields) <= set(rows.columns):
                rows = rows.withColumns({f: F.lit(None) for f in fields if f not in rows.columns})
            bad = unique_violations(rows, fields, index["sparse"], out="_count").limit(1).first()
            if bad is None and kept:
                old = self._read(kept)
                if set(fields) <= set(old.columns):
                    keyed = rows.where(F.coalesce(*[F.col(f"`{f}`").cast("string") for f in fields]).isNotNull()) if index["sparse"] else rows
                    a = keyed.select(F.struct(*[F.col(f"`{f}`") for f in fields]).alias("k"))
                    b = old.select(F.struct(*[F.col(f"`{f}`") for f in fields]).alias("k"))
                    bad = a.join(b, a["k"].eqNullSafe(b["k"]), "left_semi").limit(1).first()
            if bad is not None:
                raise DuplicateKeyError(f"index {name}: duplicate key {json.dumps(bad.asDict(True), default=str)}")

    def insert_many(self, df: DataFrame) -> int:
        """Append a batch, all of it or none: validated, within the caps, its keys unique, with fresh ids. Returns their number."""
        extra = {"_version": F.lit(1).cast("bigint")} | ({} if "_id" in df.columns else {"_id": F.uuid()})
        part = self._write(df.withColumns(extra))

        def add(head: dict) -> dict:
            rows = self._read([part])
            self._check(head, rows)
            for cap, of in ((head["cap"], "count"), (head["cap_bytes"], "bytes")):
                if cap is not None and sum(p[of] for p in [*head["parts"], part]) > cap:
                    raise CapacityError(f"more than {cap} {'documents' if of == 'count' else 'bytes'}")
            self._check_unique(head, head["parts"], part)
            return head | {"parts": [*head["parts"], part]}

        try:
            self._commit(add)
        except Exception:
            self._remove(part)
            raise
        return part["count"]

    def insert_one(self, doc: dict) -> str:
        doc = doc if "_id" in doc else doc | {"_id": str(uuid.uuid4())}
        self.insert_many(self._frame([doc]))
        return doc["_id"]

    def _frame(self, docs: list[dict]) -> DataFrame:
        return self.spark.read.json(self.spark.sparkContext.parallelize([json.dumps(d) for d in docs]))

    def _rewrite(self, query: dict, change: Callable[[DataFrame], DataFrame], unique: bool) -> int:
        """Rewrite the parts that hold a match, as one new part; the others stay as they are. Returns the matches."""
        done = 0

        def apply(head: dict) -> dict | None:
            nonlocal done
            done = 0
            if not head["parts"]:
                return None
            df = self._read(head["parts"])
            of = F.regexp_extract(F.col("_metadata.file_path"), "(part-[0-9a-f]{32})/", 1)
            hits = {r["part"]: r["n"] for r in df.where(compile_filter(query, df.schema, where=True)).groupBy(of.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
            done = sum(hits.values())
            if not done:
                return None
            kept = [p for p in head["parts"] if p["name"] not in hits]
            old = self.spark.read.schema(df.schema).parquet(*[f"{self.path}/{p}" for p in hits])
            part = self._write(change(old))
            try:
                self._check(head, self._read([part]))
                if unique:
                    self._check_unique(head, kept, part)
            except Exception:
                self._remove(part)
                raise
            return head | {"parts": self._with(kept, part)}

        self._commit(apply)
        return done

    def update_many(self, query: dict, update: dict) -> int:
        touched = {path.split(".")[0] for _, path, _ in parse_update(update)} | {str(v) for op, _, v in parse_update(update) if op == "$rename"}
        unique = any(touched & {f.split(".")[0] for f in i["fields"]} for i in self.head()[1]["indexes"].values() if i["unique"])
        return self._rewrite(query, lambda df: apply_update(df, query, update, "_version"), unique)

    def replace_one(self, doc_id: str, doc: dict) -> int:
        """The document of an id becomes ``doc``, under the same id and the next version; fields that ``doc`` lacks are gone."""

        def change(df: DataFrame) -> DataFrame:
            hit = F.coalesce(F.col("_id") == doc_id, F.lit(False))
            new = self._frame([{k: v for k, v in doc.items() if not k.startswith("_")}])
            ids = df.where(hit).select("_id", (F.col("_version") + 1).alias("_version"))
            return df.where(~hit).unionByName(ids.crossJoin(F.broadcast(new)), allowMissingColumns=True)

        return self._rewrite({"_id": doc_id}, change, True)

    def delete_many(self, query: dict) -> int:
        return self._rewrite(query, lambda df: delete_many(df, query), False)

    def apply(self, ops: list[tuple[str, object, object]]) -> int:
        """(operation, id, data) in turn, as one head: insert a document, update by id, replace, delete. Returns their number."""
        number, head = self.head()
        df = self._read(head["parts"])
        schema, ids = df.schema, [i for op, i, _ in ops if op != "insert"]
        of = F.regexp_extract(F.col("_metadata.file_path"), "(part-[0-9a-f]{32})/", 1)
        hit = {r[0] for r in df.where(F.col("_id").isin(ids)).select(of).distinct().collect()} if ids and head["parts"] else set()
        kept = [p for p in head["parts"] if p["name"] not in hit]
        out = self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in hit]) if hit else None
        for op, i, data in ops:
            if op == "insert":
                new = self._frame([data if i is None else data | {"_id": i}]).withColumn("_version", F.lit(1).cast("bigint"))
                new = new if "_id" in new.columns else new.withColumn("_id", F.lit(str(uuid.uuid4())))
                out = new if out is None else out.unionByName(new, allowMissingColumns=True)
            elif out is not None:
                out = delete_many(out, {"_id": i}) if op == "delete" else apply_update(out, {"_id": i}, data, "_version")
        if out is None:
            return 0
        part = self._write(out)
        try:
            self._check(head, self._read([part]))
            self._check_unique(head, kept, part)
            self._commit(lambda h: h | {"parts": self._with(kept, part)}, expected=number)
        except Exception:
            self._remove(part)
            raise
        return len(ops)

    # --- indexes and upkeep

    def create_index(self, name: str, fields: list[str], unique: bool = False, sparse: bool = False) -> None:
        """Record an index; of a unique one, present rows are checked now and every write from now on."""
        if unique and self.count():
            bad = unique_violations(self.df(), fields, sparse, out="_count").limit(1).first()
            if bad is not None:
                raise DuplicateKeyError(f"duplicate key {bad.asDict()}")
        self._commit(lambda h: h | {"indexes": h["indexes"] | {name: {"fields": fields, "unique": unique, "sparse": sparse}}})

    def drop_index(self, name: str) -> None:
        def less(h: dict) -> dict:
            if name not in h["indexes"]:
                raise NotFoundError(f"no index {name}")
            return h | {"indexes": {k: v for k, v in h["indexes"].items() if k != name}}

        self._commit(less)

    def indexes(self) -> dict[str, dict]:
        return self.head()[1]["indexes"]

    def checkpoint(self) -> None:
        """All rows in one new part, so that later reads open few files."""
        self._commit(lambda h: h | {"parts": [self._write(self._read(h["parts"]))]} if len(h["parts"]) > 1 else None)

    def vacuum(self) -> int:
        """Remove the parts and heads that the newest head doesn't need; returns the parts removed. No reader may be on an older one."""
        number, head = self.head()
        fs, used = _fs(self.spark, self.path), {p["name"] for p in head["parts"]}
        stale = [s.getPath() for s in fs.listStatus(_path(self.spark, self.path)) if s.getPath().getName().startswith("part-") and s.getPath().getName() not in used]
        for p in stale:
            fs.delete(p, True)
        for n in self._heads():
            if n < number:
                fs.delete(_path(self.spark, f"{self.path}/heads/{n:012d}.json"), False)
        return len(stale)

    def drop(self) -> None:
        _fs(self.spark, self.path).delete(_path(self.spark, self.path), True)


class Database:
    """Collections by name under one folder; what is there is what the folder holds, whoever made it."""

    def __init__(self, spark: SparkSession, path: str, name: str = "default"):
        self.spark, self.path, self.name = spark, f"{path}/{name}", name

    def create_collection(self, name: str, schema: Schema | None = None, cap: int | None = None, cap_bytes: int | None = None) -> Collection:
        return Collection(self.spark, f"{self.path}/{name}").create(schema, cap, cap_bytes)

    def collection(self, name: str) -> Collection:
        c = Collection(self.spark, f"{self.path}/{name}")
        if not c.exists():
            raise NotFoundError(f"no collection {name}")
        return c

    def get_or_create(self, name: str) -> Collection:
        return self.collection(name) if self.exists(name) else self.create_collection(name)

    def exists(self, name: str) -> bool:
        return Collection(self.spark, f"{self.path}/{name}").exists()

    def list_collections(self) -> list[str]:
        fs, p = _fs(self.spark, self.path), _path(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
        return sorted(n for n in names if self.exists(n))

    def drop_collection(self, name: str) -> None:
        self.collection(name).drop()

    def create(self) -> None:
        _fs(self.spark, self.path).mkdirs(_path(self.spark, self.path))

    def drop(self) -> None:
        _fs(self.spark, self.path).delete(_path(self.spark, self.path), True)

    def stats(self) -> dict[str, int]:
        return {n: self.collection(n).count() for n in self.list_collections()}

    # helpers by collection name

    def insert(self, name: str, doc: dict) -> str:
        return self.get_or_create(name).insert_one(doc)

    def find(self, name: str, query: dict | None = None, **kw) -> DataFrame:
        return self.collection(name).find(query, **kw)

    def update(self, name: str, query: dict, update: dict) -> int:
        return self.collection(name).update_many(query, update)

    def delete(self, name: str, query: dict) -> int:
        return self.collection(name).delete_many(query)


def list_databases(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path), _path(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
    return sorted(n for n in names if n[0] not in "._")
