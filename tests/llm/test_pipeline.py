"""The corpus pipeline against brute force, stage by stage and as a whole."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from tessera.llm import bpe, langid

from .test_dedup import brute_pairs
from .test_sampling import brute_mix


def test_stages_are_as_declared():
    assert [n for n, _ in P.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing", "byte-level BPE"]


def brute(rows, model):
    score, n = langid.score_batch(model, pa.array([r["text"] for r in rows]), {}, [np.empty((0, len(model.langs)))])
    ok = langid._decide(model.langs, score, n, langid.MIN_POSTERIOR)[3].to_pylist()
    rows = [r for r, o in zip(rows, ok) if o]
    first = {}
    for r in rows:
        first[r["text"]] = min(first.get(r["text"], r["doc_id"]), r["doc_id"])
    rows = [r for r in rows if first[r["text"]] == r["doc_id"]]
    parent = {r["doc_id"]: r["doc_id"] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute_pairs([(r["doc_id"], r["text"]) for r in rows]):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    rows = [r for r in rows if root(r["doc_id"]) == r["doc_id"]]
    copies = brute_mix([(r["doc_id"], r["source"], r["n_chars"]) for r in rows])
    text = {r["doc_id"]: r["text"] for r in rows}
    codec = bpe.Codec.get(bpe.VOCABULARY)
    out = Counter()
    for (i, _, c), k in copies.items():
        if c:
            out[i, tuple(codec.tok.encode(text[i], add_special_tokens=False).ids)] += c * k
    return out


def test_whole_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute(docs.collect(), langid.fit(langid.training_counts(docs)))
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in P.run(spark, sf).collect())
    assert got == want


@pytest.mark.parametrize("k", range(5))
def test_stages_on_nasty_and_empty_rows(spark, nasty, empty, sf, k):
    name, stage = P.STAGES[k]
    out = stage(spark, nasty, sf)
    assert stage(spark, empty, sf).count() == 0
    if k < 4:
        assert out.columns == nasty.columns and 0 < out.count() <= nasty.count()
    else:
        assert out.count() == nasty.count()
