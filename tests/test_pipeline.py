import pytest
from pyspark.sql import functions as F

from tessera.errors import QueryParseError
from tessera.plans.pipeline import aggregate
from tessera.plans.updates import apply_update, delete_many, parse_update


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "a", 5, [1, 2]), (2, "b", None, []), (3, None, 7, None), (4, "a", 1, [3])], "id int, g string, v int, arr array<int>")


def test_unwind(docs):
    assert sorted(r["id"] for r in aggregate(docs, [{"$unwind": "$arr"}]).collect()) == [1, 1, 4]
    keep = aggregate(docs, [{"$unwind": {"path": "$arr", "preserveNullAndEmptyArrays": True}}]).collect()
    assert sorted(r["id"] for r in keep) == [1, 1, 2, 3, 4]
    assert aggregate(docs, [{"$unwind": "$v"}]).count() == 0
    assert aggregate(docs, [{"$unwind": {"path": "$v", "preserveNullAndEmptyArrays": True}}]).count() == 4


def test_group_keys(docs):
    got = {r["_id"]: (r["n"], r["s"]) for r in aggregate(docs, [{"$group": {"_id": "$g", "n": {"$count": {}}, "s": {"$sum": "$v"}}}]).collect()}
    assert got == {"a": (2, 6.0), "b": (1, 0.0), None: (1, 7.0)}
    rendered = aggregate(docs, [{"$group": {"_id": {"x": "$g", "y": "$v"}}}], render_keys=True).collect()
    assert {r["_id"] for r in rendered} == {'"a"|5', '"b"|null', "null|7", '"a"|1'}
    assert aggregate(docs.where("false"), [{"$group": {"_id": None, "n": {"$count": {}}}}]).count() == 0


def test_ordered_accumulators(docs):
    spec = {"_id": None, "first": {"$first": "$v"}, "last": {"$last": "$v"}, "all": {"$push": "$v"}}
    row = aggregate(docs, [{"$sort": {"id": -1}}, {"$group": spec}]).first()
    assert (row["first"], row["last"], row["all"]) == (1, 5, [1, 7, 5])
    row = aggregate(docs.coalesce(1), [{"$group": spec}]).first()
    assert (row["first"], row["last"], row["all"]) == (5, 1, [5, 7, 1])


@pytest.mark.parametrize("sort", [{"g": -1, "id": 1}, {"g": 1, "id": -1}, {"v": -1, "g": 1}, {"v": 1, "id": 1}, {"arr": -1}, {"absent": 1}])
def test_accumulators_see_the_order_of_the_sort(docs, sort):
    """Of any type, in any direction, and with projections, filters and limits between."""
    ids = [r["id"] for r in aggregate(docs.coalesce(1), [{"$sort": sort}]).collect()]
    for between in ([], [{"$project": {"id": 1}}], [{"$match": {}}, {"$addFields": {"x": 1}}], [{"$limit": 4}, {"$skip": 0}]):
        out = aggregate(docs.coalesce(1), [{"$sort": sort}, *between, {"$group": {"_id": None, "all": {"$push": "$id"}, "first": {"$first": "$id"}, "last": {"$last": "$id"}}}])
        row = out.first()
        assert (row["all"], row["first"], row["last"]) == (ids, ids[0], ids[-1]) and out.columns == ["_id", "all", "first", "last"]
    nulls = aggregate(docs.coalesce(1), [{"$sort": {"v": -1}}, {"$group": {"_id": None, "first": {"$first": "$v"}}}]).first()
    assert nulls["first"] is None


def test_ties_keep_their_order_and_elements_theirs(docs, spark):
    rows = spark.createDataFrame([(i, i % 2, [i, -i]) for i in range(40)], "id int, k int, a array<int>").coalesce(1)
    got = aggregate(rows, [{"$sort": {"id": -1}}, {"$sort": {"k": 1}}, {"$group": {"_id": None, "all": {"$push": "$id"}}}]).first()["all"]
    assert got == [i for i in range(39, -1, -1) if i % 2 == 0] + [i for i in range(39, -1, -1) if i % 2]
    got = aggregate(rows, [{"$sort": {"id": 1}}, {"$unwind": "$a"}, {"$group": {"_id": "$k", "all": {"$push": "$a"}}}]).collect()
    assert {r["_id"]: r["all"] for r in got} == {k: [x for i in range(k, 40, 2) for x in (i, -i)] for k in (0, 1)}
    assert aggregate(rows, [{"$sort": {"id": 1}}]).columns == ["id", "k", "a"]


def test_sort_puts_missing_last_up_and_first_down(docs):
    assert [r["id"] for r in aggregate(docs, [{"$sort": [("v", True)]}]).collect()][-1] == 2
    assert [r["id"] for r in aggregate(docs, [{"$sort": [("v", False)]}]).collect()][0] == 2


def test_lookup_gives_an_empty_array_without_a_partner(docs, spark):
    other = spark.createDataFrame([("a", 10), ("a", 11), ("c", 12), (None, 13)], "k string, w int")
    rows = aggregate(docs, [{"$lookup": {"from": "o", "localField": "g", "foreignField": "k", "as": "m"}}], {"o": other}).collect()
    assert {r["id"]: [x["w"] for x in r["m"]] for r in rows} == {1: [10, 11], 2: [], 3: [], 4: [10, 11]}


def test_count_and_limits(docs):
    assert aggregate(docs.where("false"), [{"$count": "n"}]).first()["n"] == 0
    assert aggregate(docs, [{"$limit": 0}]).count() == 0
    assert aggregate(docs, [{"$skip": "x"}]).count() == 4


def test_projection(docs):
    assert aggregate(docs, [{"$project": {"g": 0, "v": 0}}]).columns == ["id", "arr"]
    assert aggregate(docs, [{"$project": {"key": "$id", "absent": 1}}]).columns == ["key"]
    assert aggregate(docs, [{"$addFields": {"z": 3}}]).first()["z"] == 3


@pytest.mark.parametrize("bad", [[{"$nope": 1}], [{"$match": {}, "$limit": 1}], [{"$group": {"_id": 3}}], [{"$replaceRoot": {"newRoot": "$v"}}]])
def test_pipeline_errors(docs, bad):
    with pytest.raises(QueryParseError):
        aggregate(docs, bad)


def test_updates(docs):
    out = {r["id"]: r for r in apply_update(docs.withColumn("version", F.lit(1)), {"g": "a"}, {"$inc": {"v": 10}, "$push": {"arr": 9}, "$set": {"g": "z"}, "new": 1}, "version").collect()}
    assert (out[1]["v"], out[1]["arr"], out[1]["g"], out[1]["version"], out[1]["new"]) == (15, [1, 2, 9], "z", 2, 1)
    assert (out[2]["v"], out[2]["arr"], out[2]["version"], out[2]["new"]) == (None, [], 1, None)
    assert apply_update(docs, {}, {"$inc": {"v": 1}}).where("id = 2").first()["v"] == 1
    assert apply_update(docs, {}, {"$pull": {"arr": 2}}).where("id = 1").first()["arr"] == [1]
    assert apply_update(docs, {"id": 1}, {"$rename": {"g": "h"}}).where("id = 1").first()["h"] == "a"
    assert delete_many(docs, {"v": {"$gt": 1}}).count() == 2
    assert parse_update({"$rename": {"a": 3}, "b": 1}) == [("$set", "b", 1)]
    nested = docs.select("id", F.struct(F.col("v").alias("x"), F.col("g").alias("y")).alias("s"))
    assert apply_update(nested, {"id": 1}, {"$set": {"s.y": "q"}, "$inc": {"s.x": 2}}).where("id = 1").first()["s"].asDict() == {"x": 7, "y": "q"}
    with pytest.raises(QueryParseError):
        parse_update([])


@pytest.fixture(scope="module")
def deep(spark):
    return spark.createDataFrame([(1, (5, "a", [1, 2], ("q",)), {"k": 1}), (2, None, None), (3, (None, None, None, None), {})], "id int, s struct<n:int,t:string,a:array<int>,d:struct<x:string>>, m map<string,int>")


@pytest.mark.parametrize(
    ("update", "path", "want"),
    [
        ({"$set": {"s.t": "z"}}, "s.t", ["z", "z", "z"]),
        ({"$set": {"s.d.x": "z"}}, "s.d.x", ["z", "z", "z"]),
        ({"$set": {"s.d.new": 4}}, "s.d.new", [4, 4, 4]),
        ({"$set": {"s.d.new": 4}}, "s.d.x", ["q", None, None]),
        ({"$set": {"fresh.a.b": True}}, "fresh.a.b", [True, True, True]),
        ({"$set": {"s.n": 2.5}}, "s.n", [2.5, 2.5, 2.5]),
        ({"$set": {"s.n": 1 << 40}}, "s.n", [1 << 40] * 3),
        ({"$set": {"s.d": {"x": "w"}}}, "s.d.x", ["w", "w", "w"]),
        ({"$unset": {"s.t": ""}}, "s.t", [None, None, None]),
        ({"$unset": {"s.none.deep": ""}}, "s.n", [5, None, None]),
        ({"$inc": {"s.n": 2}}, "s.n", [7, 2, 2]),
        ({"$inc": {"s.d.k": 2}}, "s.d.k", [2, 2, 2]),
        ({"$push": {"s.a": 3}}, "s.a", [[1, 2, 3], [3], [3]]),
        ({"$push": {"s.b": "x"}}, "s.b", [["x"]] * 3),
        ({"$push": {"s.a": 0.5}}, "s.a", [[1.0, 2.0, 0.5], [0.5], [0.5]]),
        ({"$pull": {"s.a": 1}}, "s.a", [[2], None, None]),
        ({"$rename": {"s.t": "s.d.y"}}, "s.d.y", ["a", None, None]),
        ({"$rename": {"s.t": "top"}}, "top", ["a", None, None]),
        ({"$set": {"m.j": 7}}, "m.j", [7, 7, 7]),
        ({"$unset": {"m.k": ""}}, "m.k", [None, None, None]),
    ],
)
def test_nested_updates(deep, update, path, want):
    from tessera.functions.values import resolve

    def at(df):
        return [r[0] for r in df.orderBy("id").select(resolve(df.schema, path)[0].alias("x")).collect()]

    assert at(apply_update(deep, {}, update)) == want
    one = apply_update(deep, {"id": 1}, update)
    others = [r["s"] for r in one.where("id <> 1").orderBy("id").select("s").collect()]
    assert at(one)[0] == want[0] and others[0] is None and others[1]["n"] is None and "_tsr_hit" not in one.columns


@pytest.mark.parametrize("bad", [{"$set": {"id": "x"}}, {"$set": {"s.t": 5}}, {"$inc": {"s.t": 1}}, {"$push": {"s.n": 1}}, {"$set": {"s.n.deeper": 1}}, {"$set": {"s.d": {"nope": 1}}}, {"$inc": {"id": "x"}}])
def test_values_that_do_not_fit_are_errors(deep, bad):
    with pytest.raises(QueryParseError):
        apply_update(deep, {}, bad)


def test_lookup_gathers_only_what_is_asked_for(docs, spark):
    other = spark.createDataFrame([("a", 10), ("zzz", 11)], "k string, w int")
    plan = aggregate(docs, [{"$lookup": {"from": "o", "localField": "g", "foreignField": "k", "as": "m"}}], {"o": other})._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    with pytest.raises(QueryParseError):
        aggregate(docs, [{"$lookup": {"from": "x", "localField": "g", "foreignField": "k", "as": "m"}}])
    assert [r["m"] for r in aggregate(docs, [{"$lookup": {"from": "o", "localField": "absent", "foreignField": "k", "as": "m"}}], {"o": other}).collect()] == [[]] * 4
