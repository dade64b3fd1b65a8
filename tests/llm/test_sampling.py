"""Mixing and sharding."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, sharding


def brute_mix(rows, weights=mixing.WEIGHTS, default=1, total=None, seed=mixing.SEED):
    """Copies of (id, source, n_chars) rows, as a multiset of (id, source, copies)."""
    size = lambda n: int(math.sqrt(max(n or 0, 0))) + 1
    by = defaultdict(list)
    for i, s, n in rows:
        by[s].append((i, size(n)))
    total = len(rows) if total is None else total
    w = {s: weights.get(s, default) for s in by}
    order = sorted(by, key=lambda s: (-(total * w[s] % sum(w.values())), s is not None, s or ""))
    n = {s: total * w[s] // sum(w.values()) for s in by}
    for s in order[: total - sum(n.values())]:
        n[s] += 1
    out = Counter()
    for s, docs in by.items():
        X = sum(x for _, x in docs)
        scored, whole = [], 0
        for i, x in docs:
            c, r = divmod(n[s] * x, X)
            whole += c
            key = "" if i is None else str(i)
            u = (int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            scored.append(((u * (X - r)) / ((1 - u) * r) if r else math.inf, key, i, c, r))
        scored.sort(key=lambda v: v[:2])
        left = n[s] - whole
        for _, _, i, c, r in scored:
            extra = int(r > 0 and left > 0)
            left -= extra
            out[i, s, c + extra] += 1
        assert left == 0
    return out


def got(df):
    return Counter((r["doc_id"], r["source"], r["copies"]) for r in df.collect())


def test_mixing_equals_brute_force(nasty, nasty_rows, empty, spark):
    rows = [(r[0], r[3], r[4]) for r in nasty_rows]
    assert got(mixing.with_copies(nasty)) == brute_mix(rows)
    many = [(i, f"s{i % 3}" if i % 7 else None, (i * 7919) % 5000) for i in range(3000)]
    df = spark.createDataFrame(many, "doc_id bigint, source string, n_chars bigint")
    for weights, total in (({"s0": 6}, None), ({"s0": 5, "s1": 2}, 12_345), ({}, 100)):
        assert got(mixing.with_copies(df, weights, total=total)) == brute_mix(many, weights, total=total)
    assert mixing.with_copies(empty).count() == 0 and mixing.mixture(empty).count() == 0


def test_targets_are_met_exactly_and_rows_are_whole(nasty, nasty_rows):
    m = mixing.mixture(nasty)
    assert m.columns == nasty.columns and m.count() == len(nasty_rows)
    n = {r["source"]: r["count"] for r in m.groupBy("source").count().collect()}
    total = len(nasty_rows)
    w = {"src0": 6, "src1": 1, "src2": 1, None: 1}
    assert all(abs(n.get(s, 0) - total * v / 9) < 1 for s, v in w.items())
    assert m.exceptAll(nasty.crossJoin(nasty.sparkSession.range(9).toDF("_c")).drop("_c")).count() == 0


def test_inclusion_follows_size(spark):
    """Over many seeds a document is drawn about as often as its share says."""
    rows = [(i, "s", (i % 10) ** 2 * 100) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_chars bigint")
    hits = Counter()
    for k in range(150):
        for (i, _, c), m in brute_mix(rows, {}, total=20, seed=f"t{k}").items():
            hits[i] += c * m
    size = [int(math.sqrt(n)) + 1 for _, _, n in rows]
    for d in range(10):
        share = sum(hits[i] for i in range(60) if i % 10 == d) / 150
        want = 20 * sum(size[i] for i in range(60) if i % 10 == d) / sum(size)
        assert abs(share - want) < 0.35 + 0.15 * want
    assert got(mixing.with_copies(df, {}, total=20, seed="t0")) == brute_mix(rows, {}, total=20, seed="t0")


def test_sharding(nasty, nasty_rows, empty, spark):
    out = sharding.shard_documents(nasty, 3, 5, slots=64)
    rows = out.collect()
    assert len(rows) == len(nasty_rows)
    slot = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) % 64
    assert all(r["slot"] == slot(r["doc_id"]) and r["shard_v1"] == r["slot"] * 3 // 64 and 0 <= r["shard_v2"] < 5 for r in rows)
    assert sharding.shard_documents(empty, 3, 5).count() == 0


def test_a_store_goes_on_from_its_newest_map(spark, empty):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"), F.lit(1).alias("slot"), F.lit(1).alias("shard_v1"))
    store = sharding.SlotMapStore(spark)
    first = {r["doc_id"]: r for r in sharding.shard_documents(docs, 3, 5, 64, store).collect()}
    second = {r["doc_id"]: r for r in sharding.shard_documents(docs, 3, 4, 64, store).collect()}
    assert {v: store.get(v).count() for v in (1, 2, 3)} == {1: 64, 2: 64, 3: 64} and store.version() == 3
    assert all(second[i]["shard_v1"] == first[i]["shard_v2"] and second[i]["shard_v2"] < 4 for i in range(500))
    assert sharding.shard_documents(empty, 3, 4, 64, store).count() == 0 and store.version() == 4
    with pytest.raises(ValueError, match="slots"):
        sharding.shard_documents(docs, 3, 4, 32, store)


def test_numbering_over_many_tasks(spark):
    rows = [(f"s{i}", i % 5) for i in range(300)] + [(None, 3)]
    df = spark.createDataFrame(rows, "s string, r int").repartition(6)
    out = mixing._numbered(df, [F.col("r").desc(), F.col("s").asc_nulls_first()], "place").collect()
    want = sorted(rows, key=lambda x: (-x[1], x[0] is not None, x[0] or ""))
    assert [(r["s"], r["r"]) for r in sorted(out, key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in out) == list(range(1, 302))


def test_mixing_with_many_sources(spark):
    rows = [(i, f"site{i % 97}", (i * 31) % 900) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_chars bigint")
    for total in (None, 333):
        assert got(mixing.with_copies(df, {"site3": 7}, total=total)) == brute_mix(rows, {"site3": 7}, total=total)


def test_rebalancing_moves_little_and_levels(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    store = sharding.SlotMapStore(spark)
    sharding.shard_documents(docs, 4, 5, 256, store)
    size = {r["slot"]: r["n_bytes"] for r in sharding.slot_sizes(docs, 256).collect()}
    v1, v2 = ({r["slot"]: r["shard"] for r in store.get(v).collect()} for v in (1, 2))
    assert sorted(v1) == sorted(v2) == list(range(256)) and store.latest().first()["version"] == 2
    load = Counter()
    for s, h in v2.items():
        load[h] += size[s]
    target = -(-sum(size.values()) // 5)
    assert set(load) == set(range(5)) and max(load.values()) <= target + max(size.values())
    assert sum(size[s] for s in v1 if v1[s] != v2[s]) <= sum(size.values()) * 0.25
    store.append(sharding.rebalanced_map(store.latest(), sharding.slot_sizes(docs, 256), 3))
    v3 = {r["slot"]: r["shard"] for r in store.latest().collect()}
    assert len(v3) == 256 and set(v3.values()) == {0, 1, 2}
