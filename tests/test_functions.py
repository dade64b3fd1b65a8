import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geo, text, vectors
from tessera.operators import codec, semantic, vector_search
from tessera.operators.search import TextIndex


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_standard_analyzer(spark):
    a = lambda s: one(spark, text.standard(F.lit(s)))
    assert a("The quick brown foxes") == ["quick", "brown", "fox"]
    assert a("x é running nations station") == ["é", "runn", "nation", "sta"]
    assert a("") == [] and a("...") == []


def test_ngrams(spark):
    assert one(spark, text.ngram(F.lit("aB c"), 2, 3)) == ["ab", "b ", " c", "ab ", "b c"]
    assert one(spark, text.ngram(F.lit("a"), 2, 3)) == []
    assert one(spark, text.edge_ngram(F.lit("hello a yo"), 2, 3)) == ["he", "hel", "yo"]
    assert one(spark, text.whitespace(F.lit("  A\tb "))) == ["a", "b"]


def test_phrases_count_positions_after_stop_words(spark):
    docs = spark.createDataFrame([(1, "brown of the dog", "x"), (2, "dog brown", "dog"), (3, "brown", "dog")], "id int, a string, b string")
    i = TextIndex(docs, "id", ["a", "b"])
    assert [r["doc"] for r in i.phrase(["brown", "dog"]).collect()] == [1]
    assert i.phrase([]).count() == 0 and i.scored([]).count() == 0
    assert {r["doc"] for r in i.boolean_and(["brown", "dog"]).collect()} == {1, 2, 3}


def test_field_weights(spark):
    docs = spark.createDataFrame([(1, "cat", "dog"), (2, "dog", "cat"), (3, "bird", "bird")], "id int, a string, b string")
    top = TextIndex(docs, "id", ["a", "b"], weights={"a": 3.0}).search("cat", 2).collect()
    assert top[0]["doc"] == 1 and top[0]["score"] > top[1]["score"]


def test_distances(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)).cast("float") for v in x])
    assert abs(one(spark, vectors.cosine_distance(arr(1, 2, 3), arr(1, 2, 3)))) < 1e-5
    assert one(spark, vectors.euclidean_distance(arr(1, 2, 3), arr(1, 2, 3))) < 1e-5
    assert abs(one(spark, vectors.dot_distance(arr(1, 0, 0), arr(0, 1, 0)))) < 1e-5
    assert abs(one(spark, vectors.magnitude(vectors.normalize(arr(3, 4)))) - 1) < 1e-5
    assert one(spark, vectors.cosine_distance(arr(0, 0), arr(1, 0))) == 1.0
    assert one(spark, vectors.manhattan_distance(arr(1, -2), arr(0, 1))) == 4.0
    assert one(spark, vectors.normalize(arr(0, 0))) == [0.0, 0.0]


def test_geo(spark):
    m = one(spark, geo.haversine(F.lit(-74.006), F.lit(40.7128), -0.1278, 51.5074))
    assert abs(m - 5_570_000) < 100_000
    ring = [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert one(spark, geo.in_polygon(F.lit(5.0), F.lit(5.0), ring)) and not one(spark, geo.in_polygon(F.lit(15.0), F.lit(5.0), ring))
    assert not one(spark, geo.in_polygon(F.lit(0.0), F.lit(0.0), []))
    pts = spark.createDataFrame([(0.0, 89.9), (180.0, 89.9), (179.9, 0.0), (-179.9, 0.0)], "lon double, lat double")
    assert geo.near(pts, 0.0, 90.0, 20_000).count() == 2
    assert geo.near(pts, 180.0, 0.0, 20_000).count() == 2
    assert geo.within_box(pts, -179.9, 0.0, 179.9, 89.9).count() == 3


def test_ann_and_pq_against_exact(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    index = vector_search.IvfIndex(e, 16)
    hits = total = 0
    for r in e.limit(8).collect():
        want = {x["vec_id"] for x in vector_search.knn(e, r["embedding"], 10).collect()}
        got = {x["vec_id"] for x in index.search(r["embedding"], 10).collect()}
        hits, total = hits + len(want & got), total + 10
    assert hits / total >= 0.9
    q = vector_search.ProductQuantizer(8, 32, rounds=8).train(e)
    codes = np.arange(8) % 32
    assert (q.encode_array(q.decode_array(codes[None])) == codes).all() and q.ratio() == 32.0


def test_knn_join_equals_knn(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    for metric in ("cosine", "euclidean", "dot", "manhattan"):
        j = vector_search.knn_join(e.where("vec_id < 3"), e, 4, metric).collect()
        for r in e.where("vec_id < 3").collect():
            want = [x["vec_id"] for x in vector_search.knn(e.where(f"vec_id <> {r['vec_id']}"), r["embedding"], 4, metric).collect()]
            assert sorted(want) == sorted(x["vec_id"] for x in j if x["query_id"] == r["vec_id"])


@pytest.mark.parametrize("data", [b"", b"a", b"a" * 600, b"\xff" * 9, bytes(range(256)) * 3, b"abcabcabcabc" + b"\xff\x00abc" * 40])
def test_codecs(data):
    assert codec.rle_decode(codec.rle_encode(data)) == data
    assert codec.lz77_decode(codec.lz77_encode(data)) == data


def test_entities_and_summary(spark):
    e = one(spark, semantic.entities(F.lit("mail a@b.c 1e5 inf NaN +3 5d 3. .5 1_0 x@y")))
    assert [(x["text"], x["kind"]) for x in e] == [("a@b.c", "EMAIL")] + [(t, "NUMBER") for t in ("1e5", "inf", "NaN", "+3", "3.", ".5")]
    assert one(spark, semantic.summarize(F.lit("é" * 5), 3)) == "ééé..."
    assert one(spark, semantic.classify(F.lit("Good NEWS"), ["news", "bad"])) == [("news", 0.85)]


def test_embedding():
    v = semantic.embed_text("abcdefgh", 4)
    assert math.isclose(float(np.linalg.norm(v)), 1.0, rel_tol=1e-6) and v[2] == 0
    assert not semantic.embed_text("", 4).any()
