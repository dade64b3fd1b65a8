"""Exact duplicates and the n-gram join against brute force."""

import random
import re
import time
from collections import defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import exact_dedup, ngram_join
from tessera.llm.ngram_join import Plan


def grams(text, n=2):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())
    return frozenset(zip(*[w[i:] for i in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_pairs(rows, n=2, threshold=ngram_join.THRESHOLD):
    docs = {(i, grams(t, n)) for i, t in rows if i is not None and t}
    docs = sorted([d for d in docs if d[1]], key=lambda d: (d[0], sorted(d[1])))
    return {tuple(sorted((a, b))) for (a, x), (b, y) in combinations(docs, 2) if len(x & y) * threshold.denominator >= len(x | y) * threshold.numerator}


def pairs_of(rows):
    """Document pairs that factored rows stand for."""
    out, same = set(), []
    for r in rows:
        left, right = r["left_ids"], r["right_ids"]
        out |= {tuple(sorted((a, b))) for a in left for b in right}
        if r["jaccard"] == 1.0:
            same.append(left + right)
    for ids in same:
        out |= {tuple(sorted(p)) for p in combinations(ids, 2)}
    return out


def test_exact_duplicates(nasty, nasty_rows, empty):
    groups = defaultdict(set)
    for r in nasty_rows:
        if r[0] is not None and r[1] is not None:
            groups[r[1]].add(r[0])
    want = {(i, min(g)) for g in groups.values() for i in g if i != min(g)}
    got = [(r["doc_id"], r["keep_id"]) for r in exact_dedup.exact_duplicates(nasty).collect()]
    assert set(got) == want and len(got) == len(want)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_exact_duplicates_beyond_the_broadcast_limit(nasty, monkeypatch):
    want = set(exact_dedup.exact_duplicates(nasty).collect())
    monkeypatch.setattr(exact_dedup, "small", lambda df, size: df)
    assert set(exact_dedup.exact_duplicates(nasty).collect()) == want
    assert exact_dedup.drop_exact_duplicates(nasty).count() == len({r["text"] for r in nasty.collect()} - {None}) + nasty.where("text IS NULL").count()


def test_each_stage_sees_only_what_the_one_before_left(spark):
    pre = "p" * exact_dedup.PREFIX_CHARS
    texts = [pre + "same!", pre + "same!", pre + "other", "q" * len(pre + "same!"), "alone", None, "", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lengths = exact_dedup.shared_lengths(df)
    prefixes = exact_dedup.shared_prefixes(df, lengths)
    full = exact_dedup.full_hashes(df, prefixes)
    assert {(r["len"], r["n"]) for r in lengths[0].collect()} == {(69, 4), (0, 2)}
    assert {(r["len"], r["n"]) for r in prefixes[0].collect()} == {(69, 3), (0, 2)}
    assert {r["id"] for r in full.collect()} == {0, 1, 2, 6, 7}
    assert {tuple(r) for r in exact_dedup.exact_duplicates(df).collect()} == {(1, 0), (7, 6)}


def test_dropping_exact_duplicates_leaves_one_row_a_text(nasty, nasty_rows, empty):
    kept = exact_dedup.drop_exact_duplicates(nasty)
    assert kept.columns == nasty.columns
    rows = kept.collect()
    texts = [r["text"] for r in rows if r["text"] is not None]
    assert sorted(texts) == sorted({r[1] for r in nasty_rows if r[1] is not None})
    assert sum(r["text"] is None for r in rows) == sum(r[1] is None for r in nasty_rows)
    least = {}
    for r in nasty_rows:
        if r[0] is not None and r[1] is not None:
            least[r[1]] = min(least.get(r[1], 1 << 60), r[0])
    assert all(r["doc_id"] == least.get(r["text"]) for r in rows if r["text"] is not None)
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_join_on_nasty_rows(nasty, nasty_rows, empty):
    got = pairs_of(ngram_join.ngram_jaccard_join(nasty).collect())
    want = brute_pairs([(r[0], r[1]) for r in nasty_rows])
    assert {p for p in got if p[0] != p[1]} == {p for p in want if p[0] != p[1]}
    assert ngram_join.ngram_jaccard_join(empty).count() == 0
    assert ngram_join.drop_near_duplicates(empty).count() == 0


def mutated(r, words, rate, vocab):
    out = []
    for w in words:
        x = r.random()
        if x < rate / 2:
            out.append(r.choice(vocab))
        elif x < rate * 0.75:
            continue
        elif x < rate:
            out += [w, r.choice(vocab)]
        else:
            out.append(w)
    return out


def corpus(seed, docs=160, common=0.4):
    """Texts of 1 to 400 words of a skewed vocabulary, some of them sharing a passage, with copies at many rates of change."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(600)]
    draw = lambda n: [vocab[min(int(r.expovariate(1 / 60)), 599)] for _ in range(n)]
    passage = draw(60)
    out = []
    for _ in range(docs):
        w = draw(r.choice([1, 2, 3, 5, 8, 13, 30, 60, 120, 400]))
        if r.random() < common:
            at = r.randint(0, len(w))
            w = w[:at] + passage + w[at:]
        out.append(w)
        for _ in range(r.choice([0, 0, 1, 3])):
            out.append(mutated(r, w, r.choice([0, 0.01, 0.03, 0.06, 0.1, 0.2]), vocab))
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def brute_classes(rows, n=2, threshold=ngram_join.THRESHOLD):
    """(id, least id of its group, links), by sets of n-grams: an id's links are those of all its texts."""
    texts = {(i, grams(t, n)) for i, t in rows if i is not None and t}
    ids, of = defaultdict(set), defaultdict(set)
    for i, g in texts:
        if g:
            ids[g].add(i)
            of[i].add(g)
    near = defaultdict(set)
    for x, y in combinations(ids, 2):
        if len(x & y) * threshold.denominator >= len(x | y) * threshold.numerator:
            near[x].add(y)
            near[y].add(x)
    out = {}
    for i in of:
        links = sum(len(ids[g]) - 1 + sum(len(ids[h]) for h in near[g]) for g in of[i])
        group, todo = {i}, [i]
        while todo:
            for g in of[todo.pop()]:
                new = {j for h in (g, *near[g]) for j in ids[h]} - group
                group |= new
                todo += new
        if links:
            out[i] = (min(group), links)
    return out


def test_classes_on_nasty_rows(nasty, nasty_rows, empty):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicate_classes(nasty).collect()}
    assert got == brute_classes([(r[0], r[1]) for r in nasty_rows])
    assert ngram_join.near_duplicate_classes(empty).count() == 0


@pytest.mark.parametrize("seed", [11, 12])
def test_classes_against_brute_force(spark, seed):
    rows = corpus(seed)
    out = ngram_join.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out}
    assert got == brute_classes(rows) and len(got) == len(out) > 50


def test_ids_that_are_not_numbers_have_no_pair(spark):
    t = "the quick brown fox jumps over the lazy dog"
    df = spark.createDataFrame([("1", t), ("2", t), ("x3", t), (None, t)], "doc_id string, text string")
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.near_duplicate_classes(df).collect()} == {(1, 1, 1), (2, 1, 1)}
    assert {r["doc_id"] for r in ngram_join.drop_near_duplicates(df).collect()} == {"1", "x3", None}


def test_clashing_names_do_not_matter(spark):
    t = "the quick brown fox jumps over the lazy dog"
    df = spark.createDataFrame([(1, t, *[0] * 9), (2, t, *[0] * 9)], "doc_id int, text string, left_ids int, right_ids int, unit int, check int, root int, v int, n int, class_id int, n_links int")
    assert ngram_join.near_duplicate_classes(df).count() == 2 and ngram_join.ngram_jaccard_join(df).count() == 1
    kept = ngram_join.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.first()["doc_id"] == 1


def test_sets_of_one_sum_are_told_apart(spark, monkeypatch):
    """With sums that clash, pairs are still those of the sets themselves."""
    real = ngram_join.unit_ids
    monkeypatch.setattr(ngram_join, "unit_ids", lambda g, per, seed=0: real(g, per, seed) if seed else np.where(per > 0, np.uint64(7) + (real(g, per) >> np.uint64(63)), np.uint64(0)))
    a, b = "one two three four five six seven eight nine ten", "red green blue white black pink brown grey gold tan"
    rows = [(1, a), (2, a), (3, b), (4, b)]
    got = ngram_join.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in got} == {(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 3, 1)}


@pytest.mark.parametrize(("seed", "threshold", "n"), [(1, Fraction(3, 4), 2), (2, Fraction(4, 5), 2), (3, Fraction(1, 2), 1), (4, Fraction(9, 10), 3), (5, Fraction(3, 4), 2)])
def test_join_finds_every_pair(spark, seed, threshold, n, monkeypatch):
    rows = corpus(seed)
    if seed == 1:  # many buckets, split segments, several packs
        monkeypatch.setattr(ngram_join, "BUCKET_SIGNATURES", 300)
        monkeypatch.setattr(ngram_join, "FLUSH_SIGNATURES", 5000)
        monkeypatch.setattr(ngram_join.Plan.lay_out, "__defaults__", (300,))
        monkeypatch.setattr(ngram_join, "PAIR_CHUNK", 500)
        monkeypatch.setattr(ngram_join, "HELD_MATCHES", 2000)
        monkeypatch.setattr(ngram_join, "BLOCK_PAIRS", 10)
    if seed == 5:  # buckets matched in parts
        monkeypatch.setattr(ngram_join, "MATCH_SIGNATURES", 900)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = ngram_join.ngram_jaccard_join(df, n, threshold).collect()
    sets = {i: grams(t, n) for i, t in rows}
    assert pairs_of(out) == brute_pairs(rows, n, threshold)
    for r in out:
        a, b = sets[r["left_ids"][0]], sets[r["right_ids"][0]]
        assert abs(r["jaccard"] - len(a & b) / len(a | b)) < 1e-12


@pytest.mark.parametrize("limit", [40, 1000])
def test_a_forest_connects_what_its_pairs_do(limit, monkeypatch):
    monkeypatch.setattr(ngram_join, "FOREST_SETS", limit)
    rng = random.Random(3)
    edges = [(rng.randrange(60), 0, rng.randrange(60), rng.randrange(2)) for _ in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges[i : i + 50])], names=["a", "a_check", "b", "b_check"]) for i in range(0, 300, 50)]
    kept = [tuple(r.values()) for b in ngram_join._forest(iter(batches)) for r in b.to_pylist()]

    def groups(rows):
        of = {}
        for a, ac, b, bc in rows:
            both = of.get((a, ac), {(a, ac)}) | of.get((b, bc), {(b, bc)})
            of |= dict.fromkeys(both, both)
        return {frozenset(g) for g in of.values() if len(g) > 1}

    assert groups(kept) == groups(edges)
    assert set(kept) <= set(edges)
    if limit == 1000:
        assert len(kept) == sum(len(g) - 1 for g in groups(edges))


def test_the_guaranteed_matches_hold():
    """Pairs at the threshold meet in as many segments as the plan says, whatever is left out."""
    r = np.random.default_rng(5)
    for documents in (10, 10**4, 10**8):
        plan = Plan(Fraction(3, 4), documents)
        plan.lay_out([(2000.0, 10)])
        for _ in range(150):
            s = int(r.integers(1, 400))
            l = int(r.integers(s, s * 4 // 3 + 1))  # noqa: E741
            inter = -(-3 * (s + l) // 7)
            if inter > s:
                continue
            pool = r.integers(0, 1 << 63, s + l - inter, dtype=np.uint64)
            a, b = pool[:s], np.concatenate([pool[:inter], pool[s:]])
            assert len(b) == l
            per = np.array([s, l])
            seen = [defaultdict(set), defaultdict(set)]
            for sig, _, who, dele, probe in ngram_join.signatures(plan, np.concatenate([a, b]), per, r.random(s + l)):
                for x, d in zip(sig.tolist(), who.tolist()):
                    seen[d][x].add((dele, probe))
            t = sum(any(not (d1 and d2) and not (p1 and p2) for d1, p1 in seen[0][x] for d2, p2 in seen[1][x]) for x in seen[0].keys() & seen[1].keys())
            need = int(plan.needed(np.array([s]), np.array([l]))[0])
            assert t >= need >= 1, (documents, s, l, t, need)


def passed_on(plan, texts, n=1):
    """(unit of each text, pairs of units that a bucket passes on, as often as one does)."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    buckets, pairs, units = defaultdict(list), [], [0] * len(texts)
    for turn in range(len(plan.rounds)):
        for out in ngram_join._sign(plan, turn, n)(iter([batch])):
            for bucket, block in zip(*out.to_pydict().values()):
                buckets[turn, bucket].append(block)
    for blocks in buckets.values():
        for out in ngram_join._match(plan)(iter([pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())] * 2, names=["bucket", "block"])])):
            for r in out.to_pylist():
                if r["need"] < 0:
                    units[r["b"]] = r["a"]
                else:
                    pairs.append((r["a"], r["b"]))
    return units, pairs


@pytest.mark.parametrize(("limit", "wide"), [(10**6, 3), (2000, 1)])
def test_some_group_passes_on_every_pair(limit, wide, monkeypatch):
    """Pairs just at the threshold, whatever their sizes, and whether or not their groups are split."""
    monkeypatch.setattr(ngram_join, "WIDE", wide)
    monkeypatch.setattr(ngram_join, "ROUND_BUCKETS", 1)
    rng = random.Random(7)
    texts = []
    for i in range(700):
        s = rng.choice([rng.randint(1, 40), rng.randint(20, 600), rng.randint(600, 2000)])
        l = rng.randint(s, s * 10 // 7)  # noqa: E741
        inter = -(-7 * (s + l) // 17)
        if inter <= s and (s, l) != (inter, inter):
            pool = [f"w{i}x{j}" for j in range(s + l - inter)]
            texts += [" ".join(pool[:s]), " ".join(pool[:inter] + pool[s:])]
    plan = Plan(Fraction(7, 10), len(texts))
    plan.lay_out([(float(len(t)), 1) for t in texts], limit)
    assert (len(plan.rounds) > 1 and plan.split.max() > 1) == (limit == 2000)
    units, pairs = passed_on(plan, texts)
    assert len(texts) > 1000
    assert {tuple(sorted(units[i : i + 2])) for i in range(0, len(texts), 2)} <= set(pairs)


def test_chance_matches_are_not_passed_on():
    """Unrelated texts meet in small segments; over many buckets all such matches were once passed on and summed."""
    rng = random.Random(8)
    texts = [" ".join(f"w{int(rng.random() ** 3 * 20_000)}" for _ in range(300)) for _ in range(600)]
    plan = Plan(Fraction(7, 10), len(texts))
    assert plan.lay_out([(2000.0, len(texts))], 1000) > 100
    _, pairs = passed_on(plan, texts, 2)
    assert len(pairs) < 20


def test_rounds_find_every_pair_and_keep_no_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(ngram_join.Plan.lay_out, "__defaults__", (2000,))
    monkeypatch.setattr(ngram_join, "ROUND_BUCKETS", 1)
    rows = corpus(6)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return sum(disk.getAllFiles().apply(i).getName().startswith("shuffle_") for i in range(disk.getAllFiles().size()))

    real, left, parts = ngram_join.written, [], []

    def written(table, name):
        before = shuffled()
        out = real(table, name)
        for _ in range(50):
            if shuffled() <= before:
                break
            time.sleep(0.1)
        left.append(shuffled() - before)
        parts.append(name)
        return out

    monkeypatch.setattr(ngram_join, "written", written)
    out = ngram_join.ngram_jaccard_join(df).collect()
    assert pairs_of(out) == brute_pairs(rows)
    assert parts.count("candidates") > 1
    assert max(left) <= 0


def test_packing():
    r = np.random.default_rng(1)
    for n in (1, 5, 70_000):
        sig = r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        docs = r.integers(0, 200, n).astype(np.uint32)
        who = docs << np.uint32(2) | r.integers(0, 4, n).astype(np.uint32)
        units, sizes = r.integers(0, 1 << 63, 200, dtype=np.uint64), r.integers(1, 900, 200)
        kind, u, z, s, w = ngram_join.unpack(ngram_join.pack(sig, who, units, sizes))
        got = sorted(zip(s.tolist(), u[w >> 2].tolist(), z[w >> 2].tolist(), (w & 3).tolist()))
        assert kind == 0 and got == sorted(zip(sig.tolist(), units[docs].tolist(), sizes[docs].tolist(), (who & 3).tolist()))


def test_gram_sets_are_those_of_the_words():
    texts = ["A b a B", "a b", "", None, "...", "one", "Ünï x-y_z 3", "a b " * 50]
    g, per = ngram_join.gram_sets(pa.array(texts), 2)
    assert per.tolist() == [len(grams(t)) if t else 0 for t in texts]
    cut = np.split(g, np.cumsum(per)[:-1])
    assert set(cut[0]) >= set(cut[1]) and set(cut[7]) == set(cut[0])


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (3, 2), (9, 1), (50, 51), (7, 7)]
    got = {r["v"]: r["root"] for r in ngram_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {1: 1, 2: 1, 3: 1, 9: 1, 50: 50, 51: 50, 7: 7}


def test_one_of_each_near_group_stays(spark):
    rows = corpus(6)
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute_pairs(rows):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {i for i, _ in rows if root(i) == i}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in ngram_join.drop_near_duplicates(df).collect()} == want


def test_near_stage_keeps_rows_without_id_or_text(nasty):
    kept = ngram_join.drop_near_duplicates(nasty)
    assert kept.columns == nasty.columns
    assert kept.where("doc_id IS NULL").count() == nasty.where("doc_id IS NULL").count()
    assert kept.where("text IS NULL OR text IN ('', '...!!')").count() == nasty.where("text IS NULL OR text IN ('', '...!!')").count()


def test_pairs_within_a_large_group_are_not_all_sought(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LARGE", 5)
    r = random.Random(5)
    words = [f"w{r.randint(0, 600)}" for _ in range(150)]
    rows = corpus(7, 60)
    rows += [(1000 + i, " ".join(mutated(r, words, 0.01 if i < 150 else 0.14, words))) for i in range(190)]
    seen, grouped = [], ngram_join._grouped
    monkeypatch.setattr(ngram_join, "_grouped", lambda pairs, members: (seen.append(pairs.count()), grouped(pairs, members))[1])
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = {x["doc_id"] for x in ngram_join.drop_near_duplicates(df).collect()}
    classes = brute_classes(rows)
    assert kept == {i for i, _ in rows if classes.get(i, (i,))[0] == i}
    assert max(seen) < len(brute_pairs(rows)) / 2


@pytest.mark.parametrize("block", [40, 2048])
def test_links_within_a_large_group_are_counted_and_not_written(spark, monkeypatch, block):
    """Every pair of a cluster was once written and verified by itself, and clusters grow with the table."""
    for name, value in (("LARGE", 5), ("CROWD", 8), ("CROSS_SETS", block)):
        monkeypatch.setattr(ngram_join, name, value)
    r = random.Random(5)
    words = [f"w{r.randint(0, 600)}" for _ in range(150)]
    rows = corpus(7, 60)
    rows += [(1000 + i, " ".join(mutated(r, words, 0.01 if i < 150 else 0.14, words))) for i in range(190)]
    rows += [(2000 + i, rows[-1 - i // 3][1]) for i in range(9)]
    sought, real = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: (out := real(df, name), name == "placed" and sought.append(out[0].count()))[0])
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in ngram_join.near_duplicate_classes(df).collect()}
    assert got == brute_classes(rows)
    assert len(sought) == 2 and sum(sought) < len(brute_pairs(rows)) / 2


def test_shared_counts():
    r = np.random.default_rng(3)
    a, b = ([np.unique(r.integers(0, 3000, r.integers(1, 400)) ** 2 // 3000).astype(np.uint64) for _ in range(k)] for k in (70, 40))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert ngram_join.shared_counts(a, b).tolist() == want
    assert ngram_join.shared_counts(a, a).tolist() == [[len(np.intersect1d(x, y)) for y in a] for x in a]
