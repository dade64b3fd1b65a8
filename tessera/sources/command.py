"""In-process JSON commands: the wire surface without a socket."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from ..errors import EngineError, NotFoundError, PermissionDenied, QueryParseError
from ..functions.values import to_extended
from ..operators import find as finds
from ..operators.security import Users, check
from ..operators.versions import TransactionManager
from .catalog import Database, list_databases


COUNTERS = ("queries_total", "query_time_us_total", "errors_total", "documents_inserted", "documents_updated", "documents_deleted", "transactions_committed")
KINDS = (
    "ping", "server_status", "list_databases", "create_database", "drop_database", "list_collections", "create_collection", "drop_collection",
    "insert_one", "insert_many", "replace_one", "find", "find_one", "count", "update_one", "update_many", "delete_one", "delete_many", "aggregate", "explain",
    "create_index", "drop_index", "list_indexes", "txn_begin", "txn_op", "txn_commit", "txn_abort", "authenticate", "create_user", "stats",
)


class Commands:
    """``execute({"type": ..., ...})`` returns ``{"ok": ..., "data": ..., "execution_time_us": ...}``.

    With ``require_auth``, a command other than ``authenticate`` and ``ping`` needs a user who
    has authenticated and a role that allows it.
    """

    NEEDS = {"find": "read", "find_one": "read", "count": "read", "aggregate": "read", "explain": "read", "insert_one": "write", "insert_many": "write", "replace_one": "write", "txn_op": "write", "txn_commit": "write", "update_one": "write", "update_many": "write", "delete_one": "delete", "delete_many": "delete", "create_collection": "createCollection", "drop_collection": "dropCollection", "create_index": "createIndex", "drop_index": "dropIndex", "create_user": "createUser"}

    def __init__(self, spark: SparkSession, path: str, require_auth: bool = False, users: Users | None = None):
        self.spark, self.path = spark, path
        self.metrics = dict.fromkeys(COUNTERS, 0)
        self.transactions = TransactionManager()
        self.require_auth, self.users, self.user = require_auth, users or Users(spark, f"{path}/.users"), None

    def execute(self, command: dict) -> dict:
        start = time.perf_counter()
        kind = command.get("type") if isinstance(command, dict) else None
        handler = getattr(self, f"_{kind}", None) if kind in KINDS else None
        self.metrics["queries_total"] += 1
        if handler is not None:
            self.metrics[f"{kind}_total"] = self.metrics.get(f"{kind}_total", 0) + 1
        try:
            if not isinstance(command, dict):
                raise QueryParseError("a command is an object")
            if handler is None:
                raise NotFoundError(f"unknown command {kind}")
            if self.require_auth and kind not in ("authenticate", "ping"):
                if self.user is None:
                    raise PermissionDenied("not authenticated")
                if kind in self.NEEDS:
                    check(self.users.roles(self.user), self.NEEDS[kind])
            out = {"ok": True, "data": handler(command)}
        except EngineError as e:
            self.metrics["errors_total"] += 1
            out = {"ok": False, "error": str(e)}
        except (KeyError, TypeError, ValueError, AttributeError, PySparkException, Py4JJavaError) as e:
            # a field that is missing or of the wrong kind
            self.metrics["errors_total"] += 1
            out = {"ok": False, "error": f"malformed {kind} command: {type(e).__name__} {str(e).splitlines()[0] if str(e) else ''}".strip()}
        took = int((time.perf_counter() - start) * 1e6)
        self.metrics["query_time_us_total"] += took
        return out | {"execution_time_us": took}

    def _db(self, c: dict) -> Database:
        name = c["name"] if c["type"] in ("create_database", "drop_database") and "name" in c else c.get("database", "default")
        return Database(self.spark, self.path, name)

    def _ping(self, c):
        return "pong"

    def _server_status(self, c):
        return {"databases": len(list_databases(self.spark, self.path)), "metrics": dict(self.metrics), "open_transactions": len(self.transactions.open), "spark": self.spark.version}

    def _list_databases(self, c):
        return list_databases(self.spark, self.path)

    def _create_database(self, c):
        self._db(c).create()

    def _drop_database(self, c):
        self._db(c).drop()

    def _list_collections(self, c):
        return self._db(c).list_collections()

    def _create_collection(self, c):
        self._db(c).create_collection(c.get("name") or c["collection"], cap=c.get("cap"), cap_bytes=c.get("cap_bytes"))

    def _drop_collection(self, c):
        self._db(c).drop_collection(c.get("name") or c["collection"])

    def _insert_one(self, c):
        self.metrics["documents_inserted"] += 1
        return self._db(c).get_or_create(c["collection"]).insert_one(c["document"])

    def _insert_many(self, c):
        col = self._db(c).get_or_create(c["collection"])
        n = col.insert_many(col._frame(c["documents"]))
        self.metrics["documents_inserted"] += n
        return n

    def _replace_one(self, c):
        return self._db(c).collection(c["collection"]).replace_one(c["id"], c["document"])

    def _find(self, c):
        df = self._db(c).collection(c["collection"]).df()
        out = finds.find(df, c.get("filter"), c.get("sort"), c.get("skip", 0), c.get("limit", 0), c.get("projection"), dialect=c.get("dialect", "wire"))
        return [to_extended(r.asDict(True)) for r in out.toLocalIterator()]

    def _find_one(self, c):
        row = finds.find_one(self._db(c).collection(c["collection"]).df(), c.get("filter"), c.get("sort"), c.get("dialect", "wire"))
        return None if row is None else to_extended(row.asDict(True))

    def _count(self, c):
        return finds.count(self._db(c).collection(c["collection"]).df(), c.get("filter"), c.get("dialect", "wire"))

    def _update_many(self, c):
        n = self._db(c).collection(c["collection"]).update_many(c.get("filter", {}), c["update"])
        self.metrics["documents_updated"] += n
        return n

    def _update_one(self, c):
        col = self._db(c).collection(c["collection"])
        row = finds.find_one(col.df(), c.get("filter"))
        return 0 if row is None else col.update_many({"_id": row["_id"]}, c["update"])

    def _delete_many(self, c):
        n = self._db(c).collection(c["collection"]).delete_many(c.get("filter", {}))
        self.metrics["documents_deleted"] += n
        return n

    def _delete_one(self, c):
        col = self._db(c).collection(c["collection"])
        row = finds.find_one(col.df(), c.get("filter"))
        return 0 if row is None else col.delete_many({"_id": row["_id"]})

    def _aggregate(self, c):
        db = self._db(c)
        wanted = {x["$lookup"]["from"] for x in c["pipeline"] if "$lookup" in x}
        others = {n: db.collection(n).df() for n in wanted if db.exists(n)}
        sink = lambda name, df: db.create_collection(name).insert_many(df.drop("_version"))
        return [to_extended(r.asDict(True)) for r in db.collection(c["collection"]).aggregate(c["pipeline"], others, sink).toLocalIterator()]

    def _explain(self, c):
        return finds.explain(self._db(c).collection(c["collection"]).df(), c.get("filter"), c.get("sort"), c.get("skip", 0), c.get("limit", 0))

    def _create_index(self, c):
        self._db(c).collection(c["collection"]).create_index(c["name"], c["fields"], bool(c.get("unique")), bool(c.get("sparse")))

    def _drop_index(self, c):
        self._db(c).collection(c["collection"]).drop_index(c["name"])

    def _list_indexes(self, c):
        return self._db(c).collection(c["collection"]).indexes()

    def _txn_begin(self, c):
        return self.transactions.begin(c.get("isolation", "snapshot"))

    def _txn_op(self, c):
        """Buffer one operation of a transaction: insert, update, replace or delete, of a document by its id."""
        if c["op"] not in ("insert", "update", "delete") or (c["op"] != "insert" and "id" not in c):
            raise QueryParseError("an operation is an insert, or an update or delete by id")
        self.transactions.add(int(c["txn_id"]), c["op"], (c.get("database", "default"), c["collection"], c.get("id", uuid.uuid4().hex)), c.get("document", c.get("update")))

    def _txn_commit(self, c):
        """Apply a transaction's operations, those of one collection as one version of it; returns their number."""
        ops = self.transactions.commit(int(c["txn_id"]))
        by: dict[tuple, list] = {}
        for op, (db, col, i), data in ops:
            by.setdefault((db, col), []).append((op, i, data))
        for (db, col), mine in by.items():
            Database(self.spark, self.path, db).get_or_create(col).apply(mine)
        self.metrics["transactions_committed"] += 1
        return len(ops)

    def _txn_abort(self, c):
        self.transactions.abort(int(c["txn_id"]))

    def _authenticate(self, c):
        if not self.users.authenticate(c["username"], c["password"]):
            raise PermissionDenied("wrong user or password")
        self.user = c["username"]
        return self.users.roles(self.user)

    def _create_user(self, c):
        self.users.create(c["username"], c["password"], c.get("roles", ["read"]))

    def _stats(self, c):
        return self._db(c).stats()
