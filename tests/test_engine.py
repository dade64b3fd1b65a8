import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import CapacityError, ConflictError, DuplicateKeyError, NotFoundError, PermissionDenied, QueryParseError, ValidationError
from tessera.operators import cache, codec, indexes, routing, search, security, semantic, sketch, validate, vector_search, versions
from tessera.sources import documents
from tessera.sources.catalog import Database
from tessera.sources.command import Commands
from tessera.streaming import changes


def test_collection_life(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    c = db.create_collection("users", validate.Schema({"age": validate.Field("int64", min=0)}), cap=3)
    assert c.count() == 0 and c.find().count() == 0
    rows = spark.createDataFrame([("ann", 30), ("bob", 40)], "name string, age bigint").withColumn("age", F.col("age") + (1 << 33))
    c.insert_many(rows)
    assert c.count() == 2 and c.count({"name": "ann"}) == 1
    assert c.update_many({"name": "ann"}, {"$set": {"name": "eve"}}) == 1
    row = c.find({"name": "eve"}).first()
    assert row["_version"] == 2 and c.find_by_id(row["_id"])["name"] == "eve"
    with pytest.raises(ValidationError):
        c.insert_many(spark.createDataFrame([("x", -(1 << 40))], "name string, age bigint"))
    with pytest.raises(CapacityError):
        c.insert_many(rows)
    assert c.delete_many({"name": "bob"}) == 1 and db.stats() == {"users": 1}
    db.drop_collection("users")
    with pytest.raises(NotFoundError):
        db.collection("users")


def test_a_database_is_what_its_folder_holds(spark, tmp_path):
    a = Database(spark, str(tmp_path))
    a.create_collection("t", validate.Schema({"n": validate.Field("any", required=True)}), cap=5).insert_many(spark.range(3).toDF("n"))
    a.collection("t").create_index("n", ["n"], unique=True)
    b = Database(spark, str(tmp_path))
    assert b.list_collections() == ["t"] and b.exists("t") and not b.exists("u")
    c = b.collection("t")
    assert c.count() == 3 and c.indexes() == {"n": {"fields": ["n"], "unique": True, "sparse": False}}
    with pytest.raises(DuplicateKeyError):
        c.insert_many(spark.range(2, 4).toDF("n"))
    with pytest.raises(DuplicateKeyError):
        c.insert_many(spark.createDataFrame([(8,), (8,)], "n bigint"))
    with pytest.raises(ValidationError):
        c.insert_many(spark.createDataFrame([("x",)], "other string"))
    with pytest.raises(CapacityError):
        c.insert_many(spark.range(10, 13).toDF("n"))
    with pytest.raises(DuplicateKeyError):
        c.update_many({}, {"$set": {"n": 1 << 33}})
    assert c.count() == 3 and len(list((tmp_path / "default" / "t").glob("part-*"))) == 1
    b.drop_collection("t")
    assert a.list_collections() == [] and not (tmp_path / "default" / "t").exists()


def test_only_parts_with_a_match_are_rewritten(spark, tmp_path):
    c = Database(spark, str(tmp_path)).create_collection("t")
    for i in range(3):
        c.insert_many(spark.range(i * 10, i * 10 + 10).toDF("n"))
    before = {p["name"] for p in c.head()[1]["parts"]}
    assert c.update_many({"n": {"$lt": 5}}, {"$inc": {"n": 1000}}) == 5
    after = {p["name"] for p in c.head()[1]["parts"]}
    assert len(before & after) == 2 and c.count() == 30 and c.count({"n": {"$gte": 1000}}) == 5
    number = c.head()[0]
    assert c.update_many({"n": -5}, {"$set": {"n": 1}}) == 0 and c.head()[0] == number
    assert c.delete_many({"n": {"$gte": 20, "$lt": 30}}) == 10 and len(c.head()[1]["parts"]) == 2
    assert c.df(number).count() == 30  # an older head still reads
    c.checkpoint()
    assert len(c.head()[1]["parts"]) == 1 and c.vacuum() == 4 and c.count() == 20


def test_of_two_writers_one_starts_again(spark, tmp_path):
    c = Database(spark, str(tmp_path)).create_collection("t")
    c.insert_many(spark.range(2).toDF("n"))
    real, raced = c._check, []

    def race(head, rows):
        if not raced:
            raced.append(1)
            Database(spark, str(tmp_path)).collection("t").insert_many(spark.range(100, 103).toDF("n"))
        real(head, rows)

    c._check = race
    c.insert_many(spark.range(10, 14).toDF("n"))
    assert c.count() == 9 and sorted(r["n"] for r in c.df().collect()) == [0, 1, 10, 11, 12, 13, 100, 101, 102]
    raced.clear()
    with pytest.raises(ConflictError):
        c.apply([("delete", c.df().first()["_id"], None)])
    assert c.count() == 12


def test_replacing_a_document(spark, tmp_path):
    c = Database(spark, str(tmp_path)).create_collection("t")
    i = c.insert_one({"a": 1, "b": "x"})
    assert c.replace_one(i, {"b": "y"}) == 1 and c.replace_one("no", {"b": "y"}) == 0
    row = c.find_by_id(i)
    assert (row["a"], row["b"], row["_version"]) == (None, "y", 2) and c.count() == 1


def test_transactions_apply(spark, tmp_path):
    x = Commands(spark, str(tmp_path)).execute
    x({"type": "insert_many", "collection": "u", "documents": [{"_id": "1", "v": 1}, {"_id": "2", "v": 2}]})
    a, b = x({"type": "txn_begin"})["data"], x({"type": "txn_begin"})["data"]
    assert x({"type": "txn_op", "txn_id": a, "op": "update", "collection": "u", "id": "1", "update": {"$inc": {"v": 10}}})["ok"]
    assert x({"type": "txn_op", "txn_id": a, "op": "insert", "collection": "new", "document": {"w": 1}})["ok"]
    assert x({"type": "txn_op", "txn_id": b, "op": "delete", "collection": "u", "id": "1"})["ok"]
    assert not x({"type": "txn_op", "txn_id": b, "op": "nonsense", "collection": "u", "id": "1"})["ok"]
    assert x({"type": "find_one", "collection": "u", "filter": {"_id": "1"}})["data"]["v"] == 1  # nothing before the commit
    assert x({"type": "txn_commit", "txn_id": a})["data"] == 2
    assert not x({"type": "txn_commit", "txn_id": b})["ok"]
    assert x({"type": "find_one", "collection": "u", "filter": {"_id": "1"}})["data"]["v"] == 11
    assert x({"type": "count", "collection": "new"})["data"] == 1 and x({"type": "count", "collection": "u"})["data"] == 2


@pytest.mark.parametrize("command", [None, 5, [], {}, {"type": None}, {"type": "find"}, {"type": "execute"}, {"type": "insert_one", "collection": "u"}, {"type": "find", "collection": "t", "filter": 3}, {"type": "aggregate", "collection": "t", "pipeline": 7}, {"type": "txn_commit", "txn_id": "x"}, {"type": "update_many", "collection": "t", "update": {"$inc": {"n": "x"}}}, {"type": "aggregate", "collection": "t", "pipeline": [{"$nope": 1}]}])
def test_malformed_commands_are_answered(spark, tmp_path, command):
    x = Commands(spark, str(tmp_path))
    x.execute({"type": "insert_one", "collection": "t", "document": {"n": 1}})
    out = x.execute(command)
    assert not out["ok"] and out["error"] and x.metrics["errors_total"] == 1


def test_expired_documents_are_not_seen(spark, tmp_path):
    c = Database(spark, str(tmp_path)).create_collection("t")
    c.insert_many(spark.range(2).select("id", F.when(F.col("id") == 0, F.timestamp_seconds(F.lit(0))).alias("_expires_at")))
    assert [r["id"] for r in c.df().collect()] == [1]


def test_commands(spark, tmp_path):
    x = Commands(spark, str(tmp_path)).execute
    assert x({"type": "ping"})["data"] == "pong"
    assert not x({"type": "nothing"})["ok"] and not x({"type": "find", "collection": "none"})["ok"]
    x({"type": "insert_many", "collection": "u", "documents": [{"n": "a", "v": 1}, {"n": "b", "v": 2}, {"n": "c"}]})
    assert x({"type": "count", "collection": "u", "filter": {"v": {"$gt": 1}}})["data"] == 1
    found = x({"type": "find", "collection": "u", "sort": [["n", False]], "limit": 2, "projection": ["n"]})
    assert found["data"] == [{"n": "c"}, {"n": "b"}]
    assert x({"type": "update_one", "collection": "u", "filter": {"n": "a"}, "update": {"$inc": {"v": 5}}})["data"] == 1
    assert x({"type": "aggregate", "collection": "u", "pipeline": [{"$group": {"_id": None, "t": {"$sum": "$v"}}}]})["data"] == [{"_id": None, "t": 8.0}]
    assert x({"type": "delete_one", "collection": "u", "filter": {"n": "c"}})["data"] == 1
    assert x({"type": "create_index", "collection": "u", "name": "i", "fields": ["n"], "unique": True})["ok"]
    assert x({"type": "list_indexes", "collection": "u"})["data"]["i"]["unique"]
    assert x({"type": "list_collections"})["data"] == ["u"] and x({"type": "explain", "collection": "u"})["ok"]
    assert not x({"type": "create_index", "collection": "u", "name": "j", "fields": ["absent"]})["ok"] or x({"type": "drop_index", "collection": "u", "name": "j"})["ok"]
    t = x({"type": "txn_begin"})["data"]
    assert x({"type": "txn_commit", "txn_id": str(t)})["ok"] and not x({"type": "txn_abort", "txn_id": str(t)})["ok"]
    assert x({"type": "create_database", "name": "d2"})["ok"] and x({"type": "list_databases"})["data"] == ["d2", "default"]
    assert x({"type": "drop_database", "name": "d2"})["ok"] and x({"type": "list_databases"})["data"] == ["default"]


def test_commands_with_roles(spark, tmp_path):
    c = Commands(spark, str(tmp_path), require_auth=True)
    c.users.create("ann", "pw", ["read"])
    assert not c.execute({"type": "find", "collection": "u"})["ok"] and c.execute({"type": "ping"})["ok"]
    assert not c.execute({"type": "authenticate", "username": "ann", "password": "x"})["ok"]
    assert c.execute({"type": "authenticate", "username": "ann", "password": "pw"})["data"] == ["read"]
    assert "needs another role" in c.execute({"type": "insert_one", "collection": "u", "document": {"a": 1}})["error"]
    assert c.metrics["errors_total"] == 3
    again = Commands(spark, str(tmp_path), require_auth=True)
    assert again.execute({"type": "authenticate", "username": "ann", "password": "pw"})["data"] == ["read"]
    assert again.execute({"type": "list_databases"})["data"] == []
    c.users.grant("ann", "readWrite")
    with pytest.raises(ConflictError):
        again.users.create("bob", "pw", ["read"])
    assert again.users.roles("ann") == ["read", "readWrite"]
    again.users.create("bob", "pw", ["read"])
    for bad in (lambda: c.users.grant("ann", "nothing"), lambda: c.users.roles("eve"), lambda: again.users.create("x", "p", ["nothing"])):
        with pytest.raises(NotFoundError):
            bad()


def test_prompt_and_settings(tmp_path):
    from tessera.cli import request
    from tessera.config import Settings

    assert request('find users {"a": 1}', "d") == {"type": "find", "database": "d", "collection": "users", "filter": {"a": 1}}
    assert request('insert u {"a": 1}', "d")["document"] == {"a": 1} and request("createcol x", "d")["name"] == "x"
    assert request("nonsense", "d") is None and request("delete u", "d")["filter"] == {}
    s = Settings(oplog_mb=1, shards=["a"])
    s.save(str(tmp_path / "s.json"))
    assert Settings.load(str(tmp_path / "s.json")) == s and s.oplog_entries == 2097


def test_transactions():
    m = versions.TransactionManager()
    a, b, c = m.begin(), m.begin(), m.begin()
    m.add(a, "update", 1)
    m.add(b, "update", 1)
    m.add(c, "update", 2)
    assert m.commit(a) == [("update", 1, None)]
    with pytest.raises(ConflictError):
        m.commit(b)
    m.commit(c)
    d = m.begin()
    m.add(d, "update", 1)
    m.commit(d)


def test_snapshot_sees_committed_versions_and_tombstones(spark):
    v = spark.createDataFrame([(1, 1, 10, "a"), (1, 2, 11, "b"), (2, 1, 10, "c"), (2, 3, 10, None)], "doc_id int, version int, txn_id int, data string")
    ok = spark.createDataFrame([(10,)], "txn_id int")
    assert {(r["doc_id"], r["data"]) for r in versions.snapshot(v, ok, 3).collect()} == {(1, "a"), (2, None)}
    assert versions.gc(v, 2).count() == 3
    assert [r["version"] for r in versions.history(v, 2).collect()] == [1, 3]


def test_ring_finds_the_successor(spark):
    import bisect
    import hashlib

    shards = [f"s{i}" for i in range(7)]
    nodes = sorted((hashlib.sha256(f"{s}:{i}".encode()).hexdigest()[:16], s) for s in shards for i in range(5))
    rows = routing.route(spark.range(500).select(F.col("id").cast("string").alias("k")), F.col("k"), routing.ring(spark, shards, 5)).collect()
    for r in rows:
        at = bisect.bisect_left([h for h, _ in nodes], hashlib.sha256(r["k"].encode()).hexdigest()[:16])
        assert r["shard"] == nodes[at % len(nodes)][1]
    one = routing.route(spark.createDataFrame([("x",), (None,)], "k string"), F.col("k"), routing.ring(spark, ["a"], 1)).collect()
    assert [r["shard"] for r in one] == ["a", None]


def test_conflicts_meet_a_row_a_key(spark):
    w = spark.createDataFrame([(1, 7), (1, 8), (2, 9), (3, 5), (3, 5), (4, None)], "doc_id int, txn_id int")
    c = spark.createDataFrame([(1, 7), (2, 9), (3, 6), (3, 5), (9, 1), (4, 2)], "doc_id int, txn_id int")
    assert {r[0] for r in versions.conflicts(w, c).collect()} == {8, 5}


def test_logs_number_on_and_pass_over_damage(spark, tmp_path):
    at = str(tmp_path / "log")
    rows = spark.createDataFrame([(10, "insert", "c", "a", None, "1"), (20, "update", "c", "a", 5, "2"), (30, "insert", "d", "x", None, "3")], "seq bigint, op string, collection string, doc_id string, txn_id bigint, data string")
    assert versions.log_append(spark, at, rows) == 3 and versions.log_append(spark, at, rows.where("false")) == 3
    more = spark.createDataFrame([(1, "drop_collection", "d", None, None, None), (2, "delete", "c", "gone", None, None)], rows.schema)
    assert versions.log_append(spark, at, more) == 5
    log = versions.log_read(spark, at)
    assert sorted(r["seq"] for r in log.collect()) == [1, 2, 3, 4, 5]
    got = {(r["collection"], r["doc_id"]): r["data"] for r in versions.recover(log).collect()}
    assert got == {("c", "a"): "1"}  # the transaction of the update has no commit, and d was dropped
    spark.read.parquet(at).where("seq = 1").withColumn("data", F.lit("damaged")).withColumn("seq", F.lit(9).cast("bigint")).write.mode("append").parquet(at)
    assert versions.log_read(spark, at).count() == 5


def test_feed_is_pulled_and_resumed(spark, tmp_path):
    feed = changes.ChangeFeed(spark, str(tmp_path / "f"), buffer=3)
    s = feed.open("db.a")
    assert feed.pending(s) == 0 and feed.next(s) is None and not feed.has_events(s)
    for i in range(5):
        feed.emit("insert", "db.a", str(i))
    feed.emit("delete", "db.b", "z")
    assert feed.pending(s) == 3 and feed.has_events(s)  # the oldest two have fallen out
    assert [r["document_id"] for r in feed.next_batch(s, 2)] == ["2", "3"] and feed.next(s)["document_id"] == "4"
    assert feed.next(s) is None
    first = feed.events().where("document_id = '3'").first()["id"]
    assert [r["document_id"] for r in feed.next_batch(feed.open(resume_after=first), 9)] == ["4", "z"]
    with pytest.raises(QueryParseError):
        feed.open(resume_after="nothing")
    with pytest.raises(QueryParseError):
        feed.emit("nonsense", "db.a")
    feed.close(s)
    assert feed.next_batch(s) == [] and feed.cleanup() == 1


@pytest.fixture(scope="module")
def orders(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet")


def test_key_indexes(spark, tmp_path, orders):
    m = indexes.KeyIndexes(spark, str(tmp_path))
    i = m.create_index(orders, "o", "price", ["o_totalprice"], id_col="o_orderkey")
    h = m.create_index(orders, "o", "cust", ["o_custkey"], kind="hash", id_col="o_orderkey")
    plan = h.lookup(7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(o_custkey,7)" in plan
    assert "GreaterThanOrEqual(o_totalprice,10.0)" in i.range(10.0)._jdf.queryExecution().executedPlan().toString()
    gone = orders.where("o_custkey = 7").select("o_orderkey")
    n = gone.count()
    assert h.lookup(7).count() == n > 0
    m.unindex_documents("o", gone)
    assert h.lookup(7).count() == 0 and i.count() == orders.count() - n
    m.index_documents("o", orders.where("o_custkey = 7"))
    assert h.lookup(7).count() == n and m.stats("o")["price"]["entries"] == orders.count()
    with pytest.raises(DuplicateKeyError):
        m.create_index(orders, "o", "bad", ["o_orderstatus"], unique=True, id_col="o_orderkey")
    assert m.list_indexes("o") == ["cust", "price"]
    m.drop_index("o", "cust")
    with pytest.raises(NotFoundError):
        m.get("o", "cust")
    with pytest.raises(QueryParseError):
        h.range(1)
    nulls = spark.createDataFrame([(1, None), (2, None), (3, 5)], "_id int, k int")
    assert m.create_index(nulls, "n", "s", ["k"], unique=True, sparse=True).count() == 1
    with pytest.raises(DuplicateKeyError):
        m.create_index(nulls, "n", "t", ["k"], unique=True)


def test_stored_text_index(spark, tmp_path):
    rows = [(1, "red fox jumps", "fox"), (2, "the fox and the red dog", None), (3, None, None), (4, "", "red"), (5, "dogs dogs dog", "x")]
    df = spark.createDataFrame(rows, "doc_id int, a string, b string")
    fresh = search.TextIndex(df, "doc_id", ["a", "b"], weights={"b": 2.0})
    m = search.TextIndexes(spark, str(tmp_path))
    m.create_index(df, "c", "t", "doc_id", ["a", "b"], weights={"b": 2.0}, buckets=4)
    stored = m.get("c", "t")
    key = lambda d: sorted(map(str, d.collect()))
    assert key(stored.postings().select("doc", "term", "tf", "positions", "wtf")) == key(fresh.postings().select("doc", "term", "tf", "positions", "wtf"))
    assert key(stored.stats()) == key(fresh.stats()) and key(stored.vocabulary()) == key(fresh.vocabulary())
    for terms in (["fox"], ["red", "fox"], ["dog", "dog", "absent"], []):
        assert key(stored.scored(terms)) == key(fresh.scored(terms))
        assert key(stored.boolean_and(terms)) == key(fresh.boolean_and(terms)) and key(stored.boolean_or(terms)) == key(fresh.boolean_or(terms))
        assert key(stored.phrase(terms)) == key(fresh.phrase(terms))
    assert key(stored.phrase(["dog", "dog"])) == key(fresh.phrase(["dog", "dog"])) != []
    assert key(stored.search("Red foxes")) == key(fresh.search("Red foxes")) and key(stored.phrase_search("red fox")) == key(fresh.phrase_search("red fox"))
    plan = stored.postings(["fox"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(term,fox)" in plan
    assert m.list_indexes("c") == ["t"] and m.stats("c", "t")["documents"] == 5
    with pytest.raises(DuplicateKeyError):
        m.create_index(df, "c", "t", "doc_id", ["a"])
    m.drop_index("c", "t")
    with pytest.raises(NotFoundError):
        m.search("c", "t", "fox")
    none = search.StoredTextIndex.build(search.TextIndex(df.where("false"), "doc_id", ["a"]), str(tmp_path / "none"))
    assert none.search("fox").count() == 0 and none.stats().first()["n_docs"] == 0


def test_vectors_that_cannot_be_used(spark, tmp_path, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(90_001, None), (90_002, [1.0]), (90_003, [float("nan")] * 64), (90_004, [None] * 64), (90_005, [])], "vec_id bigint, embedding array<float>")
    both = e.unionByName(odd.select(F.col("vec_id").cast(e.schema["vec_id"].dataType), "embedding"))
    asked = both.where("vec_id < 40 OR vec_id > 90000")
    true = {(r["query_id"], r["vec_id"]) for r in vector_search.knn_join(asked, both, 5).collect()}
    assert true == {(r["query_id"], r["vec_id"]) for r in vector_search.knn_join(e.where("vec_id < 40"), e, 5).collect()} and len(true) == 200
    ivf = vector_search.StoredIvf.build(both, str(tmp_path / "ivf"), 8)
    got = {(r["query_id"], r["vec_id"]) for r in ivf.join(asked, 5).collect()}
    assert len(got & true) >= 0.9 * len(true)
    every = {(r["query_id"], r["vec_id"]) for r in ivf.join(asked, 5, probes=8).collect()}
    assert every == true
    assert "PartitionFilters: [" in (p := ivf.search([0.5] * 64, 3)._jdf.queryExecution().executedPlan().toString()) and "cell" in p.split("PartitionFilters")[1][:80]
    pq = vector_search.ProductQuantizer(8, 16).train(both)
    assert pq.encode(both).count() == e.count()


def test_ties_at_the_last_place_go_by_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(100, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    got = {}
    for r in vector_search.knn_join(df.where("vec_id IN (0, 30, 100)"), df, 3).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert got == {0: {1, 2, 3}, 30: {0, 1, 2}, 100: {0, 1, 2}}


def test_named_vector_indexes(spark, tmp_path, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    m = vector_search.VectorIndexes(spark, str(tmp_path))
    m.create_index(e, "c", "v", cells=4, quantize=True)
    q = e.where("vec_id = 3").first()["embedding"]
    assert m.search("c", "v", q, 1).first()["vec_id"] == 3 and m.search("c", "v", q, 1, "vec_id <> 3").first()["vec_id"] != 3
    m.remove("c", "v", e.where("vec_id = 3").select("vec_id"))
    assert m.search("c", "v", q, 1).first()["vec_id"] != 3
    m.index("c", "v", e.where("vec_id IN (3, 4)"))
    assert m.search("c", "v", q, 1).first()["vec_id"] == 3 and m.stats("c", "v")["vectors"] == e.count()
    pq, codes = m.quantizer("c", "v")
    assert pq.distances(codes, q).count() == e.count() and m.list_indexes("c") == ["v"]
    m.drop_index("c", "v")
    with pytest.raises(NotFoundError):
        m.get("c", "v")


@pytest.mark.parametrize("name", ["rle", "lz77", "snappy"])
def test_codecs_round_trip(name):
    import random

    enc, dec = {"rle": (codec.rle_encode, codec.rle_decode), "lz77": (codec.lz77_encode, codec.lz77_decode), "snappy": (codec.snappy_encode, codec.snappy_decode)}[name]
    r = random.Random(3)
    for data in (b"", b"a", b"\xff", b"\xff" * 700, b"ab" * 900, b"a" * 255, b"a" * 256, bytes(range(256)) * 3, *(bytes(r.choices(range(3), k=r.randint(0, 400))) for _ in range(60))):
        assert dec(enc(data)) == data
    if name == "lz77":  # a literal marker is three bytes, and a match the longest and nearest of three bytes or more
        assert codec.lz77_encode(b"\xff") == b"\xff\x00\x00" and codec.lz77_encode(b"abcabcabc") == b"abc\xff\x03\x06"
        assert codec.lz77_encode(b"abxabyab") == b"abxabyab"


def test_cache_drops_what_was_used_longest_ago():
    gone = []
    c = cache.LruCache(2, gone.append)
    c.put("a", 1), c.put("b", 2)
    assert c.get("a") == 1 and c.put("c", 3) == 2 and gone == [2] and c.get("b") is None
    assert c.put("a", 9) == 1 and len(c) == 2 and c.stats() == (1, 1) and c.hit_rate() == 0.5 and c.remove("a") == 9


def test_generated_text_keeps_whole_characters(spark):
    for t in ("short", "x" * 49 + "é tail", "é" * 40, "日本" * 30, "", "x" * 47 + "🙂🙂"):
        want = t.encode()[:50].decode("utf-8", "ignore")
        got = spark.createDataFrame([(t,)], "t string").select(semantic.generate(F.col("t"), 7).alias("g")).first()["g"]
        assert got == f"[Generated text based on: '{want}' (max 7 tokens)]"
    with pytest.raises(QueryParseError):
        semantic.ModelConfig(provider="remote")


def test_extended_json_comes_back():
    import datetime

    from tessera.functions.values import from_extended, to_extended

    v = {"a": datetime.datetime(2024, 1, 2, 3, 4), "b": b"\x00\xff", "c": [1, {"d": datetime.date(2024, 1, 2)}], "e": {"$other": 1}}
    assert from_extended(to_extended(v)) == v and from_extended({"$oid": "x"}) == "x"


def test_places_in_stored_tiles(spark, tmp_path):
    from tessera.functions import geo

    pts = spark.range(4000).select("id", (F.col("id") * 7919 % 36000 / 100.0 - 180).alias("lon"), (F.col("id") * 104729 % 18000 / 100.0 - 90).alias("lat"))
    pts = pts.unionByName(spark.createDataFrame([(9001, 180.0, 10.0), (9002, -180.0, 10.0), (9003, None, 1.0), (9004, 5.0, 90.0)], "id bigint, lon double, lat double"))
    g = geo.GridIndex.build(pts, str(tmp_path / "g"))
    ids = lambda d: sorted(r["id"] for r in d.collect())
    for lon, lat, m in ((0, 0, 5e5), (179.9, 10, 1e6), (-179.9, 10, 1e6), (30, 89, 8e5), (-60, -88, 4e5), (10, 60, 3e7), (175, -45, 2e6)):
        exact = pts.withColumn("d", geo.haversine(F.col("lon"), F.col("lat"), lon, lat)).where(F.col("d") <= m)
        assert ids(g.near(lon, lat, m)) == ids(geo.near(pts, lon, lat, m)) == ids(exact) == ids(geo.within(pts, geo.Circle(lon, lat, m)))
    assert ids(g.within_box(-20.5, -10.5, 33.3, 90)) == ids(geo.within_box(pts, -20.5, -10.5, 33.3, 90))
    ring = [(-30.0, -30.0), (40.0, -25.0), (10.0, 50.0)]
    assert ids(g.within_polygon(ring)) == ids(geo.within_polygon(pts, ring)) and g.within_polygon(ring[:2]).count() == 0
    assert "PartitionFilters: [tile" in g.near(0, 0, 1e5)._jdf.queryExecution().executedPlan().toString()
    line = geo.LineString(((0.0, 0.0), (10.0, 10.0)))
    two = spark.createDataFrame([(1, 5.0, 5.0), (2, 5.0, 6.0)], "id int, lon double, lat double")
    assert ids(geo.within(two, line)) == [1] and ids(geo.within(two, geo.Point(5.0, 6.0))) == [2]


def test_patterns_are_those_of_the_jvm(spark):
    from tessera.plans.filters import compile_filter, safe_pattern

    df = spark.createDataFrame([("éa1",), ("123",), ("x",)], "s string")
    assert df.where(compile_filter({"s": {"$regex": r"\p{L}+"}}, df.schema)).count() == 2
    assert not safe_pattern("(") and not safe_pattern("(?=x)") and safe_pattern(r"^\p{IsAlphabetic}$")
    s = validate.Schema({"s": validate.Field("string", pattern=r"^\p{L}")})
    assert validate.validate(df, s).where("_errors IS NOT NULL").count() == 1


def test_ring_moves_only_what_it_must(spark):
    keys = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    four = routing.route(keys, F.col("k"), routing.ring(spark, ["a", "b", "c", "d"], 64)).toDF("k", "x")
    five = routing.route(keys, F.col("k"), routing.ring(spark, ["a", "b", "c", "d", "e"], 64)).toDF("k", "y")
    j = four.join(five, "k")
    assert j.where("x <> y AND y <> 'e'").count() == 0 and 0 < j.where("y = 'e'").count() < 1000


def test_bloom_query_is_sized_by_its_table(spark, tmp_path):
    from tessera.queries import _bloom

    spark.range(100_000).toDF("o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(90_000, 110_000).toDF("c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = _bloom(spark, str(tmp_path)).where("maybe")
    assert got.where("c_custkey < 100000").count() == 10_000
    assert got.where("c_custkey >= 100000").count() < 300


def test_bloom(spark):
    b = sketch.BloomFilter(1000, 0.01).build(spark.range(1000), "id")
    assert b.might_contain(spark.range(1000), "id").where("NOT maybe").count() == 0
    assert b.might_contain(spark.range(10_000, 20_000), "id").where("maybe").count() < 300


def test_security(spark):
    u = security.Users()
    u.create("ann", "pw", ["read"])
    assert u.authenticate("ann", "pw") and not u.authenticate("ann", "no") and not u.authenticate("bob", "pw")
    with pytest.raises(PermissionDenied):
        security.check(u.roles("ann"), "write")
    u.grant("ann", "readWrite")
    security.check(u.roles("ann"), "write")
    key = b"k" * 32
    row = spark.range(1).select(security.encrypt(F.lit("abc"), key).alias("e")).select("e", security.decrypt(F.col("e"), key).cast("string").alias("d")).first()
    assert row["d"] == "abc" and len(row["e"]) == 12 + 3 + 16


def test_validation_messages(spark):
    df = spark.createDataFrame([(1, "ab", [1, 2, 3], (5,)), (50, None, [], (500,))], "n int, s string, a array<int>, d struct<x:int>")
    V = validate.Field
    s = validate.Schema({"n": V("int32", max=10, allowed_values=[1, 2]), "s": V("string", required=True, pattern="^a"), "a": V("array", min_length=1), "d": V("document", nested=validate.Schema({"x": V("int32", max=9)})), "z": V(required=True, default=3)})
    got = [r["_errors"] for r in validate.validate(df, s).collect()]
    assert got == [None, "n is above 10; n isn't an allowed value; s is required; a is shorter than 1; d.x is above 9"]
    assert validate.validate(df.select("n"), validate.Schema({"n": V("string", min_length=3)})).first()["_errors"] == "n must be string"


def test_dynamic_documents(spark):
    texts = ['{"a":5,"n":{"b":[1,2]}}', '{"a":5.0}', '{"a":null}', "{}", "[1]", "oops", '{"a":3000000000,"s":"x"}']
    v = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", documents.dynamic(F.col("t")).alias("v"))
    tags = {r["i"]: r["tag"] for r in v.select("i", documents.tag(F.col("v"), "a").alias("tag")).collect()}
    assert tags == {0: "int32", 1: "double", 2: "null", 3: None, 4: None, 5: None, 6: "int64"}
    assert [r["i"] for r in v.where(documents.variant_equals(F.col("v"), "a", 5)).collect()] == [0]
    assert [r["i"] for r in v.where(documents.variant_equals(F.col("v"), "a", 5.0)).collect()] == [1]
    assert v.where(documents.variant_exists(F.col("v"), "a")).count() == 4


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    texts = [r["json"] for r in documents.to_json(df).collect()]
    assert [json.loads(t) for t in texts] == [{"a": 1, "b": "x"}, {"a": 2}]
    documents.to_json(df).write.text(str(tmp_path / "j"))
    assert sorted(documents.read_json(spark, str(tmp_path / "j"), "a int, b string").collect()) == sorted(df.collect())


def test_change_feed_resumes(spark, tmp_path):
    e = spark.createDataFrame([("1", "insert", "db.a", 1), ("2", "delete", "db.ab", 2), ("3", "update", "db.b", 3)], "id string, change_type string, namespace string, cluster_time bigint")
    e.write.parquet(str(tmp_path / "in"))
    run = lambda: changes.deliver(changes.watch(changes.source(spark, str(tmp_path / "in"), e.schema), "db.a", ["insert", "delete"]), str(tmp_path / "out"), str(tmp_path / "ck"))
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    e.limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def shuffled(spark):
    """Records of all shuffles so far."""
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_text_index_shuffles_postings_and_not_words(spark, tmp_path):
    """Each word's occurrence was once shuffled by itself and sorted, which spilled."""
    rows = [(i, " ".join(f"Word{(i + k) % 9} naïve-{k % 3} the x {'lying' * (k % 2)}" for k in range(100)), "Übung running tests" if i % 2 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, a string, b string")
    fresh, before = search.TextIndex(df, "doc_id", ["a", "b"], weights={"b": 2.5}), shuffled(spark)
    stored = search.StoredTextIndex.build(fresh, str(tmp_path / "x"))
    moved, words = shuffled(spark) - before, fresh.tokens.count()
    assert moved < words / 4
    cols = ["doc", "term", "tf", "positions", "wtf"]
    assert sorted(map(str, stored.postings().select(cols).collect())) == sorted(map(str, fresh.postings().select(cols).collect()))
    assert stored.meta["avgdl"] == words / len(rows)


@pytest.mark.parametrize("analyzer", ["standard", "whitespace", "keyword", "edge_ngram"])
def test_a_text_index_of_repeated_ids_and_odd_texts(spark, tmp_path, analyzer):
    odd = ["", None, "...", "a the", "cat Cats cat's", "ÄÖ ß ﬁ İstanbul e\u0301te", "lies 日本語 ing xing", "cat " * 50]
    rows = [(i, t) for i, t in enumerate(odd)] + [(4, "cat Cats cat's"), (4, "dogs running"), (None, "cat"), (None, "cat"), (None, None)]
    fresh = search.TextIndex(spark.createDataFrame(rows, "doc_id bigint, a string"), "doc_id", ["a"], analyzer)
    stored = search.StoredTextIndex.build(fresh, str(tmp_path / "x"))
    tokens = fresh.docs.select("doc", F.size("tokens").alias("dl"), F.inline_outer("tokens")).where("term IS NOT NULL")
    want = tokens.groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    got = stored.postings().select("doc", "dl", "term", "tf", "positions")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot", "manhattan"])
def test_a_join_of_neighbours_copies_rows_a_few_times_only(spark, monkeypatch, metric):
    """Each row was once copied for each block of 2048 of the other table. Copies of a vector tie, and go by id."""
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 50)
    r = np.random.default_rng(2)
    one = np.concatenate([r.normal(size=(499, 24)), np.zeros((1, 24))]).astype(np.float32)
    x = np.tile(one, (4, 1)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(4)
    before = shuffled(spark)
    got = {(q["query_id"], q["vec_id"]) for q in vector_search.knn_join(df, df, 5, metric).collect()}
    assert shuffled(spark) - before < len(x) * 2 * 20
    # distances of different vectors, so that copies are at the same
    d = np.array([[vector_search._pair_distances(a[None].astype(float), b[None].astype(float), metric)[0] for b in one] for a in one])
    d = np.tile(d, (4, 4))
    np.fill_diagonal(d, np.inf)
    assert got == {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:5]}
