import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.errors import QueryParseError
from tessera.operators.find import Cursor, explain, find
from tessera.plans import filters as P

SCHEMA = "i int, d double, s string, b boolean, doc struct<n:int,l:array<struct<c:int>>>, arr array<struct<x:int,y:string>>"
ROWS = [
    (5, 5.0, "abc", True, {"n": 1, "l": [{"c": 1}, {"c": 2}]}, [{"x": 1, "y": "p"}, {"x": 7, "y": "q"}]),
    (None, None, None, None, None, None),
    (-3, 0.5, "", False, {"n": None, "l": []}, []),
    (7, 3e9, "zeta", None, {"n": 9, "l": [{"c": 5}]}, [{"x": 7, "y": "p"}]),
]

leaf = st.one_of(
    st.builds(lambda f, v: {f: v}, st.sampled_from(["i", "d", "s", "b", "doc.n", "doc.l.0.c", "none"]), st.sampled_from([5, 5.0, -3, 0.5, "abc", True, None, 1])),
    st.builds(lambda f, o, v: {f: {o: v}}, st.sampled_from(["i", "d", "s", "doc.n", "none"]), st.sampled_from(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte"]), st.sampled_from([5, 5.0, 0, 0.5, "abc", "m"])),
    st.builds(lambda f, o, v: {f: {o: v}}, st.sampled_from(["i", "d", "s", "none"]), st.sampled_from(["$in", "$nin"]), st.lists(st.sampled_from([5, 5.0, "abc", -3, ""]), max_size=3)),
    st.builds(lambda f, v: {f: {"$exists": v}}, st.sampled_from(["i", "doc.n", "doc.l.1.c", "none"]), st.booleans()),
    st.builds(lambda v: {"s": {"$regex": v}}, st.sampled_from(["a", "^z", "c$", "(", "(?=a)"])),
    st.builds(lambda f, v: {f: {"$type": v}}, st.sampled_from(["i", "d", "s", "doc"]), st.sampled_from(["int32", "double", "string", "document"])),
    st.builds(lambda v, w: {"arr": {"$elemMatch": {"x": {"$gte": v}, "y": w}}}, st.sampled_from([1, 7]), st.sampled_from(["p", "q"])),
)
query = st.recursive(leaf, lambda q: st.one_of(st.builds(lambda o, xs: {o: xs}, st.sampled_from(["$and", "$or", "$nor"]), st.lists(q, max_size=3)), st.builds(lambda x: {"$not": x}, q)), max_leaves=5)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def as_dict(r):
    return r.asDict(True)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(q=query)
def test_compiled_filters_mean_what_the_model_says(rows, q):
    got = sorted(str(as_dict(r)) for r in rows.where(P.compile_filter(q, rows.schema)).collect())
    want = sorted(str(as_dict(r)) for r in rows.collect() if P.matches(q, as_dict(r)))
    assert got == want, q


@pytest.mark.parametrize("bad", [[], {"$and": {}}, {"a": {"$in": 3}}, {"a": {"$exists": 1}}, {"a": {"$regex": 3}}, {"a": {"$type": 3}}])
def test_parse_errors(bad):
    with pytest.raises(QueryParseError):
        P.parse(bad)


def test_numbers_are_equal_across_types_only_when_asked(rows):
    assert rows.where(P.compile_filter({"d": 5}, rows.schema)).count() == 0
    assert rows.where(P.compile_filter({"d": 5}, rows.schema, coerce=True)).count() == 1


def test_wire_dialect(rows):
    n = lambda q: rows.where(P.compile_filter(q, rows.schema, "wire")).count()
    assert n({"i": None}) == 1 and n({"none": None}) == 4
    assert n({"i": {"$ne": 5}}) == 2
    assert n({"i": {"$exists": False}}) == 0
    assert n({"i": {"$odd": 1}}) == 3
    assert n({"i": {"$nin": 5}}) == 3 and n({"i": {"$in": 5}}) == 0
    assert n({"doc.l.0.c": 1}) == 0


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/customer.parquet")
    plan = find(df, {"c_acctbal": {"$gt": 10.0}}, projection=["c_custkey"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_acctbal" in plan and "c_name" not in plan
    e = explain(df, {"c_custkey": {"$gt": 5}}, sort=[("c_custkey", True)], limit=3)
    assert e["pushed"] and "TakeOrderedAndProject" in e["plan"]


def test_cursor(spark):
    c = Cursor(spark.range(25).orderBy("id"), 10)
    assert [len(c.next_batch()) for _ in range(4)] == [10, 10, 5, 0]
    c.rewind()
    assert c.total() == 25 and c.remaining() == 25 and len(c.collect_all()) == 25 and not c.has_next()
