"""Registered queries of the document engine over the test tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import CapacityError, ConflictError, DuplicateKeyError, ValidationError
from .functions import geo, text, values, vectors
from .operators import cache, codec, indexes, replication, routing, search, security, semantic, sketch, validate, vector_search, versions
from .operators.find import Cursor, explain, find
from .plans.filters import compile_filter
from .plans.pipeline import aggregate
from .plans.updates import apply_update, delete_many
from .sources import documents, scratch
from .sources.catalog import Collection, Database
from .sources.command import Commands
from .streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _fresh(spark: SparkSession) -> str:
    """A folder of this query's own."""
    return f"{scratch.shared_dir(spark)}/tessera-queries/{uuid.uuid4().hex}"


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


# --- filters -----------------------------------------------------------------------------------


def _filter(name: str, tab: str, query: dict, cols: list[str], where: str, dialect: str = "filter") -> None:
    add(name, lambda s, d: find(table(s, d, tab), query, projection=cols, dialect=dialect), f"SELECT {', '.join(cols)} FROM {tab} WHERE {where}")


C = ["c_custkey", "c_name", "c_acctbal"]
_filter("f_all", "nation", {}, ["n_nationkey", "n_name"], "true")
_filter("f_eq", "customer", {"c_mktsegment": "BUILDING"}, C, "c_mktsegment = 'BUILDING'")
_filter("f_eq_strict", "lineitem", {"l_quantity": 20}, ["l_orderkey"], "false")
_filter("f_eq_double", "lineitem", {"l_quantity": 20.0}, ["l_orderkey", "l_linenumber"], "l_quantity = 20")
_filter("f_ne", "customer", {"c_mktsegment": {"$ne": "BUILDING"}}, C, "c_mktsegment <> 'BUILDING'")
_filter("f_gt", "customer", {"c_acctbal": {"$gt": 5000}}, C, "c_acctbal > 5000")
_filter("f_gte", "part", {"p_size": {"$gte": 40}}, ["p_partkey", "p_size"], "p_size >= 40")
_filter("f_lt", "customer", {"c_acctbal": {"$lt": 0.0}}, C, "c_acctbal < 0")
_filter("f_lte", "part", {"p_size": {"$lte": 5.0}}, ["p_partkey", "p_size"], "p_size <= 5")
_filter("f_in", "orders", {"o_orderstatus": {"$in": ["F", "P"]}}, ["o_orderkey", "o_orderstatus"], "o_orderstatus IN ('F', 'P')")
_filter("f_nin", "orders", {"o_orderstatus": {"$nin": ["F", "P"]}}, ["o_orderkey", "o_orderstatus"], "o_orderstatus NOT IN ('F', 'P')")
_filter("f_exists", "customer", {"c_name": {"$exists": True}, "nothing": {"$exists": False}}, C, "c_name IS NOT NULL")
_filter("f_regex", "customer", {"c_name": {"$regex": "0[0-4]7$"}}, C, "regexp_matches(c_name, '0[0-4]7$')")
_filter("f_type", "customer", {"c_acctbal": {"$type": "double"}, "c_custkey": {"$type": "int32"}}, C, "c_custkey BETWEEN -2147483648 AND 2147483647")
_filter("f_and", "customer", {"$and": [{"c_acctbal": {"$gt": 1000}}, {"c_nationkey": {"$lt": 10}}]}, C, "c_acctbal > 1000 AND c_nationkey < 10")
_filter("f_or", "customer", {"$or": [{"c_acctbal": {"$gt": 9000}}, {"c_nationkey": 3}]}, C, "c_acctbal > 9000 OR c_nationkey = 3")
_filter("f_not", "customer", {"$not": {"c_acctbal": {"$gt": 1000}}}, C, "NOT c_acctbal > 1000")
_filter("f_nor", "customer", {"$nor": [{"c_acctbal": {"$gt": 1000}}, {"c_nationkey": 3}]}, C, "NOT (c_acctbal > 1000 OR c_nationkey = 3)")
_filter("f_implicit_and", "part", {"p_size": {"$gte": 10, "$lt": 20}, "p_retailprice": {"$gt": 1000}}, ["p_partkey"], "p_size >= 10 AND p_size < 20 AND p_retailprice > 1000")
_filter("f_unknown_operator", "customer", {"c_name": {"$regex": "x", "$options": "i"}}, C, "false")
_filter("f_empty_operators", "nation", {"n_name": {}}, ["n_name"], "true")


def _props(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.from_json("props", "k int").alias("props"))


add("f_nested_path", lambda s, d: find(_props(s, d), {"props.k": {"$gte": 50}}, projection=["event_id", "props.k"]).toDF("event_id", "k"), "SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events WHERE CAST(props->>'$.k' AS INTEGER) >= 50")


def _turns(s: SparkSession, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.char_length("text").cast("bigint").alias("n"))))
    return table(s, d, "conversations").groupBy("conv_id").agg(rows.alias("turns"))


add("f_elem_match", lambda s, d: find(_turns(s, d), {"turns": {"$elemMatch": {"role": "user", "n": {"$gt": 500}}}}, projection=["conv_id"]), "SELECT DISTINCT conv_id FROM conversations WHERE role = 'user' AND length(text) > 500")
add("f_array_index", lambda s, d: find(_turns(s, d), {"turns.1.role": "assistant"}, projection=["conv_id"]), "SELECT conv_id FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, length(text)) AS r FROM conversations) WHERE r = 2 AND role = 'assistant'")
add("f_in_array_equality", lambda s, d: find(_turns(s, d).select("conv_id", F.transform("turns", lambda x: x["role"]).alias("roles")), {"roles": ["user", "assistant"]}, projection=["conv_id"]), "SELECT conv_id FROM (SELECT conv_id, list(role ORDER BY turn, role, length(text)) AS r FROM conversations GROUP BY 1) WHERE r = ['user', 'assistant']")


def _nulls(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select("c_custkey")
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"))
    return c.join(o, "c_custkey", "left")


_N = "(SELECT c_custkey, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)"
for _name, _q, _w, _d in (
    ("f_missing_null", {"top": None}, "false", "filter"),
    ("f_ne_missing", {"top": {"$ne": 5.0}}, "true", "filter"),
    ("f_exists_false", {"top": {"$exists": False}}, "top IS NULL", "filter"),
    ("w_missing_null", {"top": None}, "top IS NULL", "wire"),
    ("w_ne_missing", {"top": {"$ne": 5.0}}, "top IS NOT NULL", "wire"),
    ("w_exists_false", {"top": {"$exists": False}}, "false", "wire"),
    ("w_unknown_op", {"top": {"$near": 1}}, "top IS NOT NULL", "wire"),
    ("w_in", {"c_custkey": {"$in": [1, 2, 3]}, "top": {"$gt": 0}}, "c_custkey IN (1, 2, 3) AND top > 0", "wire"),
    ("w_logical_is_field", {"$and": [{"c_custkey": 1}]}, "false", "wire"),
    ("w_exists_true", {"top": {"$exists": True}}, "top IS NOT NULL", "wire"),
    ("w_type_ignored", {"top": {"$type": "string"}}, "top IS NOT NULL", "wire"),
    ("w_elem_match_ignored", {"top": {"$elemMatch": {"x": 1}}}, "top IS NOT NULL", "wire"),
    ("w_in_scalar", {"c_custkey": {"$in": 5}}, "false", "wire"),
    ("w_nin_scalar", {"c_custkey": {"$nin": 5}}, "true", "wire"),
):
    add(_name, lambda s, d, q=_q, x=_d: find(_nulls(s, d), q, dialect=x, projection=["c_custkey"]), f"SELECT c_custkey FROM {_N} WHERE {_w}")

add("w_nested_document", lambda s, d: find(_props(s, d), {"props": {"k": 1}}, dialect="wire", projection=["event_id"]), "SELECT event_id FROM events")
add("w_array_index", lambda s, d: find(_turns(s, d), {"turns.1.role": "assistant"}, dialect="wire", projection=["conv_id"]), "SELECT conv_id FROM conversations WHERE false")

# --- find --------------------------------------------------------------------------------------
O = ["o_orderkey", "o_totalprice"]  # noqa: E741
add("find_sort", lambda s, d: find(table(s, d, "orders"), {"o_orderstatus": "P"}, sort=[("o_totalprice", False), ("o_orderkey", True)], projection=O), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
add("find_skip_limit", lambda s, d: find(table(s, d, "orders"), sort=[("o_orderkey", True)], skip=100, limit=50, projection=O), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
add("find_topk", lambda s, d: find(table(s, d, "orders"), sort=[("o_totalprice", False), ("o_orderkey", True)], limit=20, projection=O), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
add("find_sort_nulls", lambda s, d: find(_nulls(s, d), sort=[("top", False), ("c_custkey", True)], limit=40, projection=["c_custkey"]), f"SELECT c_custkey FROM {_N} ORDER BY top DESC NULLS FIRST, c_custkey LIMIT 40")
add("find_project", lambda s, d: find(table(s, d, "supplier"), projection=["s_suppkey", "s_name", "absent"]), "SELECT s_suppkey, s_name FROM supplier")
add("find_count", lambda s, d: find(table(s, d, "lineitem"), {"l_returnflag": "R"}).agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
add("find_by_id", lambda s, d: find(table(s, d, "orders"), {"o_orderkey": 7}, projection=O), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")

# --- pipeline ----------------------------------------------------------------------------------


def _pipe(name: str, tab: str, stages: list[dict], sql: str | None, others: tuple = (), final: Callable | None = None, **kw) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        df = aggregate(table(s, d, tab) if isinstance(tab, str) else tab(s, d), stages, {o: table(s, d, o) for o in others}, **kw)
        return final(df) if final else df

    add(name, run, sql)


FLAGSHIP = [{"$match": {"l_returnflag": "R"}}, {"$group": {"_id": "$l_linestatus", "revenue": {"$sum": "$l_extendedprice"}, "discount": {"$avg": "$l_discount"}, "n": {"$sum": 1}}}, {"$sort": {"_id": 1}}]
_pipe("flagship", "lineitem", FLAGSHIP, "SELECT l_linestatus AS _id, round(sum(l_extendedprice), 2) AS revenue, round(avg(l_discount), 6) AS discount, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1", final=lambda df: df.withColumns({"revenue": F.round("revenue", 2), "discount": F.round("discount", 6)}))
_pipe("p_match", "orders", [{"$match": {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}}, {"$project": {"o_orderkey": 1}}], "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
_pipe("p_project_inc", "nation", [{"$project": {"n_name": 1, "n_regionkey": 1, "absent": 1}}], "SELECT n_name, n_regionkey FROM nation")
_pipe("p_project_exc", "nation", [{"$project": {"n_name": 0, "n_regionkey": 0}}], "SELECT n_nationkey FROM nation")
_pipe("p_project_rename", "nation", [{"$project": {"name": "$n_name", "key": "$n_nationkey"}}], "SELECT n_name AS name, n_nationkey AS key FROM nation")
_pipe("p_group_field", "orders", [{"$group": {"_id": "$o_orderpriority", "n": {"$count": {}}}}], "SELECT o_orderpriority AS _id, count(*) AS n FROM orders GROUP BY 1")
_pipe("p_group_null", "orders", [{"$group": {"_id": None, "n": {"$count": {}}, "top": {"$max": "$o_totalprice"}}}], "SELECT CAST(NULL AS VARCHAR) AS _id, count(*) AS n, max(o_totalprice) AS top FROM orders")
_pipe("p_group_empty", "orders", [{"$match": {"o_orderstatus": "none"}}, {"$group": {"_id": None, "n": {"$count": {}}}}, {"$project": {"n": 1}}], "SELECT 1::BIGINT AS n WHERE false")
_pipe("p_group_compound", "lineitem", [{"$group": {"_id": {"f": "$l_returnflag", "s": "$l_linestatus"}, "n": {"$count": {}}}}], "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY 1, 2", final=lambda df: df.select("_id.f", "_id.s", "n"))
_pipe("p_group_rendered", "lineitem", [{"$group": {"_id": "$l_returnflag", "n": {"$count": {}}}}], "SELECT '\"' || l_returnflag || '\"' AS _id, count(*) AS n FROM lineitem GROUP BY 1", render_keys=True)
_pipe("p_sort", "supplier", [{"$sort": {"s_acctbal": -1, "s_suppkey": 1}}, {"$limit": 10}, {"$project": {"s_suppkey": 1}}], "SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
_pipe("p_limit", "nation", [{"$sort": {"n_nationkey": 1}}, {"$limit": 5}, {"$project": {"n_name": 1}}], "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 5")
_pipe("p_skip", "nation", [{"$sort": {"n_nationkey": 1}}, {"$skip": 20}, {"$project": {"n_name": 1}}], "SELECT n_name FROM nation ORDER BY n_nationkey OFFSET 20")
_pipe("p_unwind", _turns, [{"$unwind": "$turns"}, {"$project": {"conv_id": 1, "turn": "$turns.turn", "role": "$turns.role"}}], "SELECT conv_id, turn, role FROM conversations")


def _some_turns(s: SparkSession, d: str) -> DataFrame:
    return _turns(s, d).withColumn("turns", F.filter("turns", lambda x: x["n"] > 900))


_pipe("p_unwind_preserve", _some_turns, [{"$unwind": {"path": "$turns", "preserveNullAndEmptyArrays": True}}, {"$project": {"conv_id": 1, "turn": "$turns.turn"}}], "SELECT c.conv_id, x.turn FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, turn FROM conversations WHERE length(text) > 900) x USING (conv_id)")
_pipe("p_count", "lineitem", [{"$match": {"l_linestatus": "O"}}, {"$count": "n"}], "SELECT count(*) AS n FROM lineitem WHERE l_linestatus = 'O'")
_pipe("p_add_fields", "region", [{"$addFields": {"kind": "region", "level": 1}}], "SELECT *, 'region' AS kind, 1 AS level FROM region")
_pipe("p_replace_root", _props, [{"$replaceRoot": {"newRoot": "$props"}}], "SELECT CAST(props->>'$.k' AS INTEGER) AS k FROM events")
_pipe("p_lookup", "nation", [{"$lookup": {"from": "customer", "localField": "n_nationkey", "foreignField": "c_nationkey", "as": "customers"}}], "SELECT n_name, count(c_custkey) AS n, coalesce(sum(c_custkey), 0)::BIGINT AS keys FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name", ("customer",), lambda df: df.select("n_name", F.size("customers").cast("bigint").alias("n"), F.aggregate("customers", F.lit(0).cast("bigint"), lambda a, x: a + x["c_custkey"]).alias("keys")))
_pipe("p_out", "region", [{"$out": "tessera_regions"}], "SELECT * FROM region", final=lambda df: df.sparkSession.table("tessera_regions"))

_G = "FROM orders GROUP BY o_orderstatus"
for _op, _sql in (("sum", "sum(o_totalprice)"), ("avg", "avg(o_totalprice)"), ("min", "min(o_totalprice)"), ("max", "max(o_totalprice)")):
    _pipe(f"a_{_op}", "orders", [{"$group": {"_id": "$o_orderstatus", "v": {f"${_op}": "$o_totalprice"}}}], f"SELECT o_orderstatus AS _id, round({_sql}, 2) AS v {_G}", final=lambda df: df.withColumn("v", F.round("v", 2)))
_pipe("a_sum_literal", "orders", [{"$group": {"_id": "$o_orderstatus", "v": {"$sum": 1}}}], f"SELECT o_orderstatus AS _id, CAST(count(*) AS DOUBLE) AS v {_G}")
_pipe("a_sum_of_text", "orders", [{"$group": {"_id": "$o_orderstatus", "v": {"$sum": "$o_orderpriority"}}}], f"SELECT o_orderstatus AS _id, 0.0::DOUBLE AS v {_G}")
_pipe("a_count", "orders", [{"$group": {"_id": "$o_orderstatus", "v": {"$count": {}}}}], f"SELECT o_orderstatus AS _id, count(*) AS v {_G}")
_BY_TURN = {"$sort": {"turn": 1, "role": 1}}
_pipe("a_push", "conversations", [_BY_TURN, {"$group": {"_id": "$conv_id", "v": {"$push": "$role"}}}], "SELECT conv_id AS _id, list(role ORDER BY turn, role) AS v FROM conversations GROUP BY 1")
_pipe("a_add_to_set", "conversations", [{"$group": {"_id": "$conv_id", "v": {"$addToSet": "$role"}}}], "SELECT conv_id AS _id, list_sort(list(DISTINCT role)) AS v FROM conversations GROUP BY 1")
_pipe("a_first", "conversations", [_BY_TURN, {"$group": {"_id": "$conv_id", "v": {"$first": "$role"}}}], "SELECT conv_id AS _id, arg_min(role, turn) AS v FROM conversations GROUP BY 1")
_pipe("a_last", "conversations", [_BY_TURN, {"$group": {"_id": "$conv_id", "v": {"$last": "$role"}}}], "SELECT conv_id AS _id, arg_max(role, turn) AS v FROM conversations GROUP BY 1")

# --- writes ------------------------------------------------------------------------------------
_B = {"c_mktsegment": "BUILDING"}
_W = "c_mktsegment = 'BUILDING'"


def _update(name: str, update: dict, cols: str, prepare: Callable = lambda df: df) -> None:
    add(name, lambda s, d: apply_update(prepare(table(s, d, "customer")), _B, update), f"SELECT {cols} FROM customer")


_update("u_set", {"$set": {"c_name": "x"}}, f"* REPLACE (CASE WHEN {_W} THEN 'x' ELSE c_name END AS c_name)")
_update("u_bare_key", {"c_nationkey": 99}, f"* REPLACE (CASE WHEN {_W} THEN 99 ELSE c_nationkey END AS c_nationkey)")
_update("u_unset", {"$unset": {"c_name": ""}}, f"* REPLACE (CASE WHEN {_W} THEN NULL ELSE c_name END AS c_name)")
_update("u_inc", {"$inc": {"c_nationkey": 5}}, f"* REPLACE (CASE WHEN {_W} THEN c_nationkey + 5 ELSE c_nationkey END AS c_nationkey)")
_update("u_rename", {"$rename": {"c_name": "name"}}, f"* REPLACE (CASE WHEN NOT {_W} THEN c_name END AS c_name), CASE WHEN {_W} THEN c_name END AS name")
_update("u_merge", {"$set": {"c_name": "y", "c_acctbal": 1.5}}, f"* REPLACE (CASE WHEN {_W} THEN 'y' ELSE c_name END AS c_name, CASE WHEN {_W} THEN 1.5 ELSE c_acctbal END AS c_acctbal)")
_tags = lambda df: df.select("c_custkey", "c_mktsegment", F.array("c_mktsegment", F.lit("a")).alias("tags"))
_update("u_push", {"$push": {"tags": "new"}}, f"c_custkey, c_mktsegment, CASE WHEN {_W} THEN [c_mktsegment, 'a', 'new'] ELSE [c_mktsegment, 'a'] END AS tags", _tags)
_update("u_pull", {"$pull": {"tags": "a"}}, f"c_custkey, c_mktsegment, CASE WHEN {_W} THEN [c_mktsegment] ELSE [c_mktsegment, 'a'] END AS tags", _tags)
add("u_delete_many", lambda s, d: delete_many(table(s, d, "customer"), {"c_acctbal": {"$lt": 0}}), "SELECT * FROM customer WHERE NOT c_acctbal < 0")

# --- text --------------------------------------------------------------------------------------
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_STEM = "CASE " + " ".join(f"WHEN ends_with(w, '{x}') AND strlen(w) > {len(x) + 2} THEN left(w, length(w) - {len(x)})" for x in text.SUFFIXES) + " ELSE w END"


def _std(col: str) -> str:
    return f"list_transform(list_filter(regexp_split_to_array(lower({col}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: strlen(w) >= 2 AND w NOT IN ({_STOP})), lambda w: {_STEM})"


add("t_standard", lambda s, d: table(s, d, "documents").select("doc_id", text.standard(F.col("text")).alias("tokens")), f"SELECT doc_id, {_std('text')} AS tokens FROM documents")
add("t_whitespace", lambda s, d: table(s, d, "documents").select("doc_id", text.whitespace(F.col("text")).alias("tokens")), r"SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS tokens FROM documents")
add("t_keyword", lambda s, d: table(s, d, "part").select("p_partkey", text.keyword(F.col("p_name")).alias("tokens")), "SELECT p_partkey, [p_name] AS tokens FROM part")
add("t_ngram", lambda s, d: table(s, d, "part").select("p_partkey", text.ngram(F.col("p_name")).alias("tokens")), "SELECT p_partkey, list_filter(list_concat(list_transform(range(1, length(p_name)), lambda i: substring(lower(p_name), i, 2)), list_transform(range(1, length(p_name) - 1), lambda i: substring(lower(p_name), i, 3))), lambda w: trim(w) <> '') AS tokens FROM part")
add("t_edge_ngram", lambda s, d: table(s, d, "nation").select("n_nationkey", text.edge_ngram(F.col("n_name"), 2, 4).alias("tokens")), r"SELECT n_nationkey, flatten(list_transform(regexp_split_to_array(lower(n_name), '\s+'), lambda w: list_transform(range(2, least(4, length(w)) + 1), lambda n: left(w, n)))) AS tokens FROM nation")


def _stored(s: SparkSession, d: str, tab: str, what: str) -> str:
    """Where an index of a table as it is now is, or will be, stored; another state of the table has another place."""
    state = scratch.fingerprint(s, f"{d}/{tab}.parquet")
    return f"{scratch.shared_dir(s)}/tessera-indexes/{hashlib.md5(f'{d}|{tab}|{state}|{what}'.encode()).hexdigest()}"


def _index(s: SparkSession, d: str) -> search.StoredTextIndex:
    """The stored index of all documents, built by the first query that asks for it."""
    at = _stored(s, d, "documents", "text")
    if scratch.exists(s, f"{at}/meta.json"):
        return search.StoredTextIndex(s, at)
    return search.StoredTextIndex.build(search.TextIndex(table(s, d, "documents"), "doc_id", ["text"]), at)


_TOK = f"tok AS (SELECT doc_id AS doc, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT doc_id, {_std('text')} AS t FROM documents)), dl AS (SELECT doc_id AS doc, len({_std('text')}) AS dl FROM documents), st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl)"
_TERMS = ("ther", "hand", "than")
_IN = ", ".join(f"'{t}'" for t in _TERMS)
_DF = f"df AS (SELECT term, count(DISTINCT doc) AS df FROM tok WHERE term IN ({_IN}) GROUP BY 1), po AS (SELECT doc, term, count(*) AS tf FROM tok WHERE term IN ({_IN}) GROUP BY 1, 2)"
_BM = "ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / a))"
add("t_postings", lambda s, d: _index(s, d).postings(list(_TERMS)).select("doc", "term", "tf", "positions"), f"WITH {_TOK} SELECT doc, term, count(*) AS tf, list(CAST(pos AS INTEGER) ORDER BY pos) AS positions FROM tok WHERE term IN ({_IN}) GROUP BY 1, 2")
add("t_stats", lambda s, d: _index(s, d).stats().select("n_docs", F.round("avgdl", 6).alias("avgdl")), f"WITH {_TOK} SELECT n AS n_docs, round(a, 6) AS avgdl FROM st")
add("t_vocabulary", lambda s, d: _index(s, d).vocabulary(), f"WITH {_TOK} SELECT term, count(DISTINCT doc) AS df, count(*) AS cf FROM tok GROUP BY 1")
add("t_bm25", lambda s, d: _index(s, d).scored([*_TERMS, _TERMS[0]]).select("doc", F.round("score", 6).alias("score"), "matched_terms"), f"WITH {_TOK}, {_DF} SELECT doc, round(sum({_BM} * CASE WHEN term = '{_TERMS[0]}' THEN 2 ELSE 1 END), 6) AS score, list_sort(list(DISTINCT term)) AS matched_terms FROM po JOIN df USING (term) JOIN dl USING (doc), st GROUP BY doc")
add("t_search", lambda s, d: _index(s, d).search(" ".join(_TERMS), 10).select("doc", F.round("score", 6).alias("score")), f"WITH {_TOK}, {_DF} SELECT doc, round(sum({_BM}), 6) AS score FROM po JOIN df USING (term) JOIN dl USING (doc), st WHERE term IN (SELECT unnest({_std("'" + ' '.join(_TERMS) + "'")})) GROUP BY doc ORDER BY sum({_BM}) DESC, doc LIMIT 10")
add("t_tfidf", lambda s, d: _index(s, d).scored(list(_TERMS), score="tfidf").select("doc", F.round("score", 8).alias("score")), f"WITH {_TOK}, {_DF} SELECT doc, round(sum(CAST(tf AS DOUBLE) / dl * ln(CAST(n AS DOUBLE) / df)), 8) AS score FROM po JOIN df USING (term) JOIN dl USING (doc), st GROUP BY doc")
add("t_and", lambda s, d: _index(s, d).boolean_and(list(_TERMS)), f"WITH {_TOK} SELECT doc FROM tok WHERE term IN ({_IN}) GROUP BY doc HAVING count(DISTINCT term) = {len(_TERMS)}")
add("t_or", lambda s, d: _index(s, d).boolean_or(list(_TERMS)), f"WITH {_TOK} SELECT DISTINCT doc FROM tok WHERE term IN ({_IN})")
_PH = ("ther", "than")
add("t_phrase", lambda s, d: _index(s, d).phrase(list(_PH)), f"WITH {_TOK} SELECT DISTINCT a.doc FROM tok a JOIN tok b ON a.doc = b.doc AND b.pos = a.pos + 1 WHERE a.term = '{_PH[0]}' AND b.term = '{_PH[1]}'")
add("t_autocomplete", lambda s, d: search.autocomplete(table(s, d, "part"), "p_partkey", "p_name", "gre", 20), r"SELECT p_partkey AS doc, 1.0::DOUBLE AS score FROM part WHERE list_bool_or(list_transform(regexp_split_to_array(lower(p_name), '\s+'), lambda w: left(w, 2) = 'gr')) ORDER BY p_partkey LIMIT 20")

# --- vectors -----------------------------------------------------------------------------------
_Q = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


def _query_vector(s: SparkSession, d: str) -> list[float]:
    return table(s, d, "embeddings").where("vec_id = 0").first()["embedding"]


_D = {
    "cosine": "1 - list_dot_product(e, f) / greatest(sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f)), 1e-10)",
    "euclidean": "sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] - q[i] AS DOUBLE) * CAST(embedding[i] - q[i] AS DOUBLE))))",
    "dot": "-list_dot_product(e, f)",
    "manhattan": "list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(abs(embedding[i] - q[i]) AS DOUBLE)))",
}
_E = f"(SELECT vec_id, embedding, q, CAST(embedding AS DOUBLE[]) AS e, CAST(q AS DOUBLE[]) AS f FROM embeddings, {_Q} x)"
for _m, _sql in _D.items():
    add(f"v_{_m}", lambda s, d, m=_m: table(s, d, "embeddings").select("vec_id", F.round(vectors.METRICS[m](F.col("embedding"), vector_search._literal(_query_vector(s, d))), 5).alias("distance")).withColumn("distance", F.when(F.col("distance") == 0, F.lit(0.0)).otherwise(F.col("distance"))), f"SELECT vec_id, CASE WHEN round({_sql}, 5) = 0 THEN 0.0 ELSE round({_sql}, 5) END AS distance FROM {_E}")
add("v_magnitude", lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(vectors.magnitude(F.col("embedding")), 6).alias("m")), f"SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS m FROM {_E}")
add("v_normalize", lambda s, d: table(s, d, "embeddings").select("vec_id", F.transform(vectors.normalize(F.col("embedding")), lambda x: F.floor(x * 10000 + 0.5)).alias("v")), f"SELECT vec_id, list_transform(e, lambda x: CAST(floor(x / sqrt(list_dot_product(e, e)) * 10000 + 0.5) AS BIGINT)) AS v FROM {_E}")
_TOP = f"SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, {_D['cosine']} AS d FROM {_E}) ORDER BY d, vec_id LIMIT 10"
add("v_knn", lambda s, d: vector_search.knn(table(s, d, "embeddings"), _query_vector(s, d), 10).select("vec_id", F.abs(F.round("distance", 6)).alias("distance")), f"SELECT vec_id, abs(distance) AS distance FROM ({_TOP})")
add("v_knn_threshold", lambda s, d: vector_search.knn_threshold(table(s, d, "embeddings"), _query_vector(s, d), 10, 0.5).select("vec_id"), f"SELECT vec_id FROM ({_TOP}) WHERE 1 - distance >= 0.5")
add("v_knn_join", lambda s, d: vector_search.knn_join(table(s, d, "embeddings"), table(s, d, "embeddings"), 3).select("query_id", "vec_id"), "SELECT query_id, vec_id FROM (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(a.e, b.e), b.vec_id) AS r FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b WHERE a.vec_id <> b.vec_id) WHERE r <= 3")


def _pq(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    q = vector_search.ProductQuantizer(8, 64).train(e)
    return q.distances(q.encode(e), _query_vector(s, d))


add("v_pq_adc", _pq)


def _cells(s: SparkSession, d: str) -> vector_search.StoredIvf:
    """The stored inverted file of all embeddings, built by the first query that asks for it."""
    at = _stored(s, d, "embeddings", "cells")
    return vector_search.StoredIvf(s, at) if scratch.exists(s, f"{at}/meta.json") else vector_search.StoredIvf.build(table(s, d, "embeddings"), at, 16)


def _recall(s: SparkSession, d: str) -> DataFrame:
    """Of the ten nearest of every hundredth row, the share that the inverted file finds."""
    e = table(s, d, "embeddings")
    asked = e.where("vec_id % 100 = 0")
    true, found = (x.select("query_id", "vec_id") for x in (vector_search.knn_join(asked, e, 10), _cells(s, d).join(asked, 10)))
    both = true.join(found, ["query_id", "vec_id"]).agg(F.count(F.lit(1)).alias("hit"))
    return true.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("queries")).crossJoin(both).select("queries", (F.col("hit") >= 0.9 * F.col("n")).alias("recall_of_0_9"))


add("v_ann", lambda s, d: _cells(s, d).search(_query_vector(s, d), 10))
add("v_ann_recall", _recall, "SELECT count(*) AS queries, true AS recall_of_0_9 FROM embeddings WHERE vec_id % 100 = 0")
add("v_pq_ratio", lambda s, d: s.createDataFrame([(vector_search.ProductQuantizer(8, 16).train(table(s, d, "embeddings")).ratio(),)], "ratio double"), "SELECT max(len(embedding)) * 4 / 8.0::DOUBLE AS ratio FROM embeddings")
add("v_stats", lambda s, d: vector_search.stats(table(s, d, "embeddings")), "SELECT count(*) AS n_vectors, max(len(embedding))::INTEGER AS dims FROM embeddings")

# --- semantic ----------------------------------------------------------------------------------
add("s_embed", lambda s, d: semantic.embed(table(s, d, "benchmark"), "item_id", "text", 32).select("item_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000 + 0.5)).alias("v")), "WITH b AS (SELECT item_id, unnest(range(strlen(text))) AS i, hex(encode(text)) AS h FROM benchmark), v AS (SELECT item_id, i // 4 % 32 AS k, sum((CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER) - 128) / 256.0::DOUBLE) AS x FROM b GROUP BY 1, 2), f AS (SELECT item_id, r.k, coalesce(x, 0) AS x FROM benchmark CROSS JOIN (SELECT unnest(range(32)) AS k) r LEFT JOIN v USING (item_id, k)), n AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM f GROUP BY 1) SELECT item_id, list(CAST(floor(CAST(CAST(CASE WHEN n > 1e-6 THEN x / n ELSE x END AS FLOAT) AS DOUBLE) * 1000 + 0.5) AS BIGINT) ORDER BY k) AS v FROM f JOIN n USING (item_id) GROUP BY item_id")


def _search_texts(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "benchmark")
    text_of = b.where("item_id = (SELECT min(item_id) FROM {b})".replace("{b}", f"parquet.`{d}/benchmark.parquet`")).first()["text"]
    return semantic.vector_search(semantic.embed(b, "item_id", "text"), text_of, 1, "item_id").select("item_id", (F.col("distance") < 1e-6).alias("same"))


add("s_vector_search", _search_texts, "SELECT min(item_id) AS item_id, true AS same FROM benchmark")
add("s_similar", lambda s, d: semantic.find_similar(table(s, d, "embeddings"), 5, 10).select("vec_id"), f"SELECT b.vec_id FROM embeddings a, embeddings b WHERE a.vec_id = 5 AND b.vec_id <> 5 ORDER BY 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id LIMIT 10")


def _hybrid(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    out = semantic.hybrid_search(e, _index(s, d), " ".join(_TERMS), _query_vector(s, d), 10, "doc_id")
    return out.select("doc_id", F.round("score", 5).alias("score"))


add("s_hybrid", _hybrid, f"WITH {_TOK}, {_DF}, kw AS (SELECT doc, sum({_BM}) AS k FROM po JOIN df USING (term) JOIN dl USING (doc), st WHERE term IN (SELECT unnest({_std("'" + ' '.join(_TERMS) + "'")})) GROUP BY doc), nn AS (SELECT vec_id, {_D['cosine']} AS d FROM {_E} ORDER BY d, vec_id LIMIT 100) SELECT vec_id AS doc_id, round(0.7 * (1 - d) + 0.3 * coalesce(k, 0), 5) AS score FROM nn LEFT JOIN kw ON doc = vec_id ORDER BY 0.7 * (1 - d) + 0.3 * coalesce(k, 0) DESC, vec_id LIMIT 10")
add("s_classify", lambda s, d: table(s, d, "documents").select("doc_id", F.size(semantic.classify(F.col("text"), ["License", "the", "token"])).alias("n")), "SELECT doc_id, (contains(lower(text), 'license')::INTEGER + contains(lower(text), 'the')::INTEGER + contains(lower(text), 'token')::INTEGER) AS n FROM documents")
_WS = r"regexp_split_to_array(text, '\s+')"
add("s_email", lambda s, d: table(s, d, "documents").select("doc_id", F.filter(semantic.entities(F.col("text")), lambda e: e["kind"] == "EMAIL")["text"].alias("emails")), f"SELECT doc_id, list_filter({_WS}, lambda w: contains(w, '@') AND contains(w, '.')) AS emails FROM documents")
add("s_number", lambda s, d: table(s, d, "documents").select("doc_id", F.filter(semantic.entities(F.col("text")), lambda e: e["kind"] == "NUMBER")["text"].alias("numbers")), f"SELECT doc_id, list_filter({_WS}, lambda w: regexp_full_match(w, '[+-]?(?i:inf|infinity|nan|\\d+\\.?\\d*(?:e[+-]?\\d+)?|\\.\\d+(?:e[+-]?\\d+)?)')) AS numbers FROM documents")
add("s_summary", lambda s, d: table(s, d, "documents").select("doc_id", semantic.summarize(F.col("text"), 80).alias("summary")), "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS summary FROM documents")
add("s_generate", lambda s, d: table(s, d, "benchmark").select("item_id", semantic.generate(F.col("text"), 64).alias("answer")), "SELECT item_id, '[Generated text based on: ''' || left(text, list_max(list_filter(range(0, 51), lambda n: strlen(left(text, n)) <= 50))) || ''' (max 64 tokens)]' AS answer FROM benchmark")
add("s_extract_text", lambda s, d: table(s, d, "nation").select("n_nationkey", semantic.extract_text(table(s, d, "nation"), ["n_name", "n_regionkey"]).alias("t")), "SELECT n_nationkey, n_name || ' ' || n_regionkey AS t FROM nation")

# --- geo ---------------------------------------------------------------------------------------


def _points(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(s, d, "customer").select("c_custkey", (k * 37 % 3600 / 10.0 - 180).alias("lon"), (k * 53 % 1700 / 10.0 - 85).alias("lat"))


_P = "(SELECT c_custkey, c_custkey * 37 % 3600 / 10.0::DOUBLE - 180 AS lon, c_custkey * 53 % 1700 / 10.0::DOUBLE - 85 AS lat FROM customer)"


def _hav(lon: float, lat: float) -> str:
    return f"2 * 6371000.0 * asin(least(1, sqrt(pow(sin(radians({lat} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin(radians({lon} - lon) / 2), 2))))"


add("g_haversine", lambda s, d: _points(s, d).select("c_custkey", F.round(geo.haversine(F.col("lon"), F.col("lat"), 2.35, 48.86), 1).alias("m")), f"SELECT c_custkey, round({_hav(2.35, 48.86)}, 1) AS m FROM {_P}")
add("g_near", lambda s, d: geo.near(_points(s, d), 2.35, 48.86, 2e6).select("c_custkey", F.round("distance", 1).alias("m")), f"SELECT c_custkey, round({_hav(2.35, 48.86)}, 1) AS m FROM {_P} WHERE {_hav(2.35, 48.86)} <= 2e6")
add("g_near_ring", lambda s, d: geo.near(_points(s, d), -179.5, 80.0, 3e6, 1e6).select("c_custkey"), f"SELECT c_custkey FROM {_P} WHERE {_hav(-179.5, 80.0)} BETWEEN 1e6 AND 3e6")
add("g_sphere", lambda s, d: geo.near(_points(s, d), 100.0, -20.0, 1e6).select("c_custkey"), f"SELECT c_custkey FROM {_P} WHERE {_hav(100.0, -20.0)} <= 1e6")
add("g_box", lambda s, d: geo.within_box(_points(s, d), -10, 35, 30, 60).select("c_custkey", F.round("distance", 1).alias("m")), f"SELECT c_custkey, round({_hav(10.0, 47.5)}, 1) AS m FROM {_P} WHERE lon BETWEEN -10 AND 30 AND lat BETWEEN 35 AND 60")
_RING = [(-10.05, 35.05), (30.05, 35.05), (10.03, 60.05)]


def _ray(ring: list[tuple[float, float]]) -> str:
    parts = [f"(({y1} > lat) <> ({y2} > lat) AND lon < (lat - {y1}) * ({x2} - {x1}) / ({y2} - {y1}) + {x1})::INTEGER" for (x1, y1), (x2, y2) in zip(ring, [ring[-1], *ring[:-1]]) if y1 != y2]
    return f"({' + '.join(parts)}) % 2 = 1"


add("g_polygon", lambda s, d: geo.within_polygon(_points(s, d), _RING).select("c_custkey"), f"SELECT c_custkey FROM {_P} WHERE {_ray(_RING)}")
add("g_cells", lambda s, d: _points(s, d).select("c_custkey", *[c.alias(n) for c, n in zip(geo.cells(F.col("lon"), F.col("lat"), 5.0), ("cx", "cy"))]), f"SELECT c_custkey, floor(lon / 5.0)::INTEGER AS cx, floor(lat / 5.0)::INTEGER AS cy FROM {_P}")

# --- validation --------------------------------------------------------------------------------


def _valid(name: str, tab: str, key: str, fields: dict, sql: str, extra: bool = True) -> None:
    add(name, lambda s, d: table(s, d, tab).select(key, validate.errors(table(s, d, tab), validate.Schema(fields, extra)).alias("errors")), f"SELECT {key}, {sql} AS errors FROM {tab}")


_V = validate.Field
_valid("val_required", "customer", "c_custkey", {"c_name": _V(required=True), "phone": _V(required=True)}, "'phone is required'")
_valid("val_type", "customer", "c_custkey", {"c_acctbal": _V("int32"), "c_name": _V("string")}, "'c_acctbal must be int32'")
_valid("val_range", "customer", "c_custkey", {"c_acctbal": _V("double", min=0, max=5000)}, "CASE WHEN c_acctbal < 0 THEN 'c_acctbal is below 0' WHEN c_acctbal > 5000 THEN 'c_acctbal is above 5000' END")
_valid("val_length", "part", "p_partkey", {"p_name": _V("string", min_length=10, max_length=14)}, "CASE WHEN strlen(p_name) < 10 THEN 'p_name is shorter than 10' WHEN strlen(p_name) > 14 THEN 'p_name is longer than 14' END")
_valid("val_pattern", "customer", "c_custkey", {"c_name": _V("string", pattern="[02468]$")}, "CASE WHEN NOT regexp_matches(c_name, '[02468]$') THEN 'c_name doesn''t match [02468]$' END")
_valid("val_enum", "orders", "o_orderkey", {"o_orderstatus": _V("string", allowed_values=["F", "O"])}, "CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus isn''t an allowed value' END")
_valid("val_extra", "region", "r_regionkey", {"r_regionkey": _V("int32")}, "'r_name isn''t in the schema'", False)
add("val_nested", lambda s, d: _props(s, d).select("event_id", validate.errors(_props(s, d), validate.Schema({"props": _V("document", nested=validate.Schema({"k": _V("int32", max=90)}))})).alias("errors")), "SELECT event_id, CASE WHEN CAST(props->>'$.k' AS INTEGER) > 90 THEN 'props.k is above 90' END AS errors FROM events")

# --- versions, logs and feeds ------------------------------------------------------------------


def _versions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("version"), (F.col("event_id") % 50).alias("txn_id"), "value", (F.col("event_type") == "error").alias("deleted"))


def _committed(s: SparkSession, d: str) -> DataFrame:
    return s.range(50).where("id % 3 <> 0").select(F.col("id").alias("txn_id"))


_VS = "(SELECT user_id AS doc_id, event_id AS version, event_id % 50 AS txn_id, value, event_type = 'error' AS deleted FROM events)"
add("mvcc_snapshot", lambda s, d: versions.snapshot(_versions(s, d), _committed(s, d), 700).select("doc_id", "version", "txn_id", "value", "deleted"), f"SELECT * FROM {_VS} WHERE version <= 700 AND txn_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) = 1")
add("mvcc_history", lambda s, d: versions.history(_versions(s, d), 7), f"SELECT * FROM {_VS} WHERE doc_id = 7")
add("mvcc_gc", lambda s, d: versions.gc(_versions(s, d), 700).select("doc_id", "version"), f"SELECT doc_id, version FROM {_VS} x WHERE version > 700 OR version = (SELECT max(version) FROM {_VS} y WHERE y.doc_id = x.doc_id AND y.version <= 700)")


def _log(s: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    return table(s, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), op.alias("op"), "value")


add("wal_replay", lambda s, d: versions.replay(_log(s, d)), "SELECT user_id AS doc_id, event_id AS seq, 'update' AS op, value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'")
add("oplog_after", lambda s, d: versions.entries_after(table(s, d, "events").select("event_id", "event_type"), 900, "event_id"), "SELECT event_id, event_type FROM events WHERE event_id > 900")
add("oplog_capped", lambda s, d: versions.capped(table(s, d, "events").select("event_id", "event_type"), 100, "event_id"), "SELECT event_id, event_type FROM events WHERE event_id > (SELECT max(event_id) - 100 FROM events)")
add("txn_conflicts", lambda s, d: versions.conflicts(_versions(s, d).where("version > 700"), _versions(s, d).where("version <= 700 AND txn_id % 3 <> 0")), f"SELECT DISTINCT a.txn_id FROM {_VS} a JOIN {_VS} b ON a.doc_id = b.doc_id AND a.txn_id <> b.txn_id WHERE a.version > 700 AND b.version <= 700 AND b.txn_id % 3 <> 0")


def _feed(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "update").otherwise("insert")
    return table(s, d, "events").select(F.col("event_id").cast("string").alias("id"), kind.alias("change_type"), F.concat(F.lit("db."), F.when(F.col("user_id") % 2 == 0, "a").otherwise("ab")).alias("namespace"), F.col("event_id").alias("cluster_time"), F.col("value"))


add("change_filter", lambda s, d: changes.watch(_feed(s, d), "db.ab", ["insert", "delete"], {"value": {"$gt": 5}}).select("id"), "SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE user_id % 2 <> 0 AND event_type <> 'view' AND value > 5")
add("change_latest", lambda s, d: changes.latest(_feed(s, d), 100).select("id"), "SELECT CAST(event_id AS VARCHAR) AS id FROM events ORDER BY event_id DESC LIMIT 100")

# --- routing, constraints, utilities -----------------------------------------------------------
_SHARDS = ["s0", "s1", "s2", "s3"]
_RINGSQL = "(SELECT left(sha256(s || ':' || i), 16) AS h, s AS shard FROM (SELECT unnest(['s0', 's1', 's2', 's3']) AS s), (SELECT unnest(range(16)) AS i))"
add("shard_route", lambda s, d: routing.route(table(s, d, "customer").select("c_custkey"), F.col("c_custkey").cast("string"), routing.ring(s, _SHARDS)), f"SELECT c_custkey, coalesce((SELECT arg_min(r.shard, r.h) FROM {_RINGSQL} r WHERE r.h >= left(sha256(CAST(c_custkey AS VARCHAR)), 16)), (SELECT arg_min(shard, h) FROM {_RINGSQL})) AS shard FROM customer")
add("shard_range", lambda s, d: table(s, d, "orders").where(routing.in_range(F.col("o_custkey"), 100, 200)).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey >= 100 AND o_custkey < 200")
add("index_unique", lambda s, d: routing.unique_violations(table(s, d, "orders"), ["o_custkey", "o_orderstatus"]), "SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")


def _keys(s: SparkSession, d: str, kind: str, fields: list[str]) -> indexes.KeyIndex:
    at = _stored(s, d, "orders", f"{kind}:{fields}")
    return indexes.KeyIndex(s, at) if scratch.exists(s, f"{at}/meta.json") else indexes.KeyIndex.create(table(s, d, "orders"), at, fields, kind, id_col="o_orderkey")


add("index_range", lambda s, d: _keys(s, d, "btree", ["o_totalprice"]).range(1000.0, 50000.0), "SELECT o_totalprice, o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000")
add("index_lookup", lambda s, d: _keys(s, d, "btree", ["o_custkey", "o_orderstatus"]).lookup(7), "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders WHERE o_custkey = 7")
add("index_hash", lambda s, d: _keys(s, d, "hash", ["o_custkey", "o_orderstatus"]).lookup(7, "O"), "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O'")


def _manager(s: SparkSession, d: str) -> DataFrame:
    """Two indexes of one collection through inserts, a refused duplicate and a removal."""
    o, m = table(s, d, "orders"), indexes.KeyIndexes(s, _fresh(s))
    low = o.where("o_orderkey % 2 = 0")
    m.create_index(low, "orders", "id", ["o_orderkey"], unique=True, id_col="o_orderkey")
    m.create_index(low, "orders", "customer", ["o_custkey"], kind="hash", id_col="o_orderkey")
    m.index_documents("orders", o.where("o_orderkey % 2 = 1"))
    try:
        m.index_documents("orders", o.limit(1))
    except DuplicateKeyError:
        m.unindex_documents("orders", o.where("o_orderkey % 10 = 0").select("o_orderkey"))
    return s.createDataFrame([(n, v["kind"], v["entries"]) for n, v in m.stats("orders").items()], "name string, kind string, entries bigint")


add("index_manager", _manager, "SELECT name, kind, (SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 0) AS entries FROM (VALUES ('id', 'btree'), ('customer', 'hash')) t(name, kind)")


def _bloom(s: SparkSession, d: str) -> DataFrame:
    keys = table(s, d, "orders").select("o_custkey")
    n = keys.agg(F.approx_count_distinct("o_custkey", 0.01)).first()[0]
    return sketch.BloomFilter(max(1, n)).build(keys, "o_custkey").might_contain(table(s, d, "customer").select("c_custkey"), "c_custkey")


def _bloom_errors(s: SparkSession, d: str) -> DataFrame:
    """Customers with orders that the filter misses, and whether it lets through under a twentieth of those without."""
    seen = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("has")).distinct()
    j = _bloom(s, d).join(seen, "c_custkey", "left").select("maybe", F.coalesce("has", F.lit(False)).alias("has"))
    return j.agg(F.count(F.when(F.col("has") & ~F.col("maybe"), 1)).alias("missed"), (F.count(F.when(~F.col("has") & F.col("maybe"), 1)) <= 0.05 * F.count(F.when(~F.col("has"), 1)) + 3).alias("few_false"))


add("bloom", _bloom_errors, "SELECT CAST(0 AS BIGINT) AS missed, true AS few_false")
add("sha256", lambda s, d: table(s, d, "customer").select("c_custkey", values.sha256_hex(F.col("c_name")).alias("h")), "SELECT c_custkey, sha256(c_name) AS h FROM customer")
add("hex_encode", lambda s, d: table(s, d, "nation").select(values.hex_encode(F.col("n_name")).alias("h")), "SELECT lower(hex(n_name)) AS h FROM nation")
_U = "CASE WHEN n >= 1099511627776 THEN printf('%.2f TB', n / 1099511627776.0::DOUBLE) WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.2f KB', n / 1024.0::DOUBLE) ELSE n || ' B' END"
add("format_bytes", lambda s, d: table(s, d, "orders").select("o_orderkey", values.format_bytes(F.col("o_orderkey") * F.col("o_orderkey") * 977).alias("t")), f"SELECT o_orderkey, {_U} AS t FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 977 AS n FROM orders)")
add("format_duration", lambda s, d: table(s, d, "orders").select("o_orderkey", values.format_duration_us(F.col("o_orderkey") * 992).alias("t")), "SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.2fs', n / 1e6::DOUBLE) WHEN n >= 1000 THEN printf('%.2fms', n / 1e3::DOUBLE) ELSE n || 'µs' END AS t FROM (SELECT o_orderkey, o_orderkey * 992 AS n FROM orders)")
add("sanitize", lambda s, d: table(s, d, "customer").select("c_custkey", values.is_valid_name(F.col("c_name")).alias("ok")), r"SELECT c_custkey, regexp_full_match(c_name, '[\p{L}\p{N}_-]+') AND strlen(c_name) <= 128 AS ok FROM customer")
add("truthy", lambda s, d: table(s, d, "labels").select("doc_id", values.is_truthy(F.col("toxic"), table(s, d, "labels").schema["toxic"].dataType).alias("t")), "SELECT doc_id, toxic <> 0 AS t FROM labels")
add("type_names", lambda s, d: table(s, d, "customer").select(*[values.type_name(F.col(f.name), f.dataType).alias(f.name) for f in table(s, d, "customer").schema.fields]), "SELECT 'int32' AS c_custkey, 'string' AS c_name, 'int32' AS c_nationkey, 'double' AS c_acctbal, 'string' AS c_mktsegment FROM customer")
add("rbac", lambda s, d: security.grants(s).where("action IN ('write', 'grantRole')"), "SELECT * FROM (VALUES ('readWrite', 'write'), ('dbAdmin', 'write'), ('userAdmin', 'grantRole'), ('root', 'write'), ('root', 'grantRole')) t(role, action)")


def _codec(name: str, tab: str = "benchmark", key: str = "item_id") -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        enc, dec = codec.CODECS[name]
        rows = table(s, d, tab).select(key, "text", enc(F.col("text")).alias("e"))
        return rows.select(key, F.decode(dec(F.col("e")), "UTF-8").alias("text"))

    return run


add("rle", _codec("rle", "documents", "doc_id"), "SELECT doc_id, text FROM documents")
add("snappy", _codec("snappy", "documents", "doc_id"), "SELECT doc_id, text FROM documents")
add("rle_bytes", lambda s, d: table(s, d, "region").select("r_regionkey", values.hex_encode(codec.CODECS["rle"][0](F.concat(F.repeat(F.lit("a"), 300), F.repeat(F.lit("b"), F.col("r_regionkey").cast("int"))))).alias("h")), "SELECT r_regionkey, 'ff612d61' || CASE WHEN r_regionkey > 0 THEN printf('%02x', r_regionkey) || '62' ELSE '' END AS h FROM region")
add("lz77", _codec("lz77"), "SELECT item_id, text FROM benchmark")
add("aes_roundtrip", lambda s, d: table(s, d, "customer").select("c_custkey", security.decrypt(security.encrypt(F.col("c_name"), b"0123456789abcdef0123456789abcdef"), b"0123456789abcdef0123456789abcdef").cast("string").alias("name")), "SELECT c_custkey, c_name AS name FROM customer")
add("json_sink", lambda s, d: documents.to_json(table(s, d, "region")), "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")


def _read_back(s: SparkSession, d: str) -> DataFrame:
    at = _fresh(s)
    documents.to_json(_props(s, d)).write.text(at)
    return documents.read_json(s, at, "event_id bigint, props struct<k:int>").select("event_id", "props.k")


add("json_source", _read_back, "SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events")


def _dynamic(s: SparkSession, d: str) -> DataFrame:
    v = documents.dynamic(F.col("props"))
    return table(s, d, "events").where(documents.variant_equals(v, "k", 42)).select("event_id", documents.tag(v, "k").alias("tag"))


add("dynamic_profile", _dynamic, "SELECT event_id, 'int32' AS tag FROM events WHERE CAST(props->>'$.k' AS INTEGER) = 42")


# --- stores and remaining operators ------------------------------------------------------------
add("v_put", lambda s, d: vector_search.put(table(s, d, "embeddings").select("vec_id", "label"), table(s, d, "embeddings").where("vec_id < 10").select("vec_id", (F.col("label") + 100).alias("label"))), "SELECT vec_id, CASE WHEN vec_id < 10 THEN label + 100 ELSE label END AS label FROM embeddings")
add("v_remove", lambda s, d: vector_search.remove(table(s, d, "embeddings").select("vec_id"), table(s, d, "embeddings").where("label = 1")), "SELECT vec_id FROM embeddings WHERE label <> 1")
add("t_phrase_search", lambda s, d: _index(s, d).scored(list(_PH), _index(s, d).phrase(list(_PH))).select("doc", F.round("score", 6).alias("score")), f"WITH {_TOK}, ph AS (SELECT DISTINCT a.doc FROM tok a JOIN tok b ON a.doc = b.doc AND b.pos = a.pos + 1 WHERE a.term = '{_PH[0]}' AND b.term = '{_PH[1]}'), po AS (SELECT doc, term, count(*) AS tf FROM tok WHERE term IN ('{_PH[0]}', '{_PH[1]}') GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1) SELECT doc, round(sum({_BM}), 6) AS score FROM po JOIN df USING (term) JOIN dl USING (doc), st WHERE doc IN (SELECT doc FROM ph) GROUP BY doc")
add("t_remove_document", lambda s, d: _index(s, d).without(s.range(100).toDF("doc_id")).groupBy("doc").agg(F.sum("tf").alias("n")), f"WITH {_TOK} SELECT doc, count(*) AS n FROM tok WHERE doc >= 100 GROUP BY 1")
add("f_coerce", lambda s, d: find(table(s, d, "lineitem"), {"l_quantity": 20}, coerce=True, projection=["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 20")
add("f_exists_as_value", lambda s, d: table(s, d, "customer").select("c_custkey", compile_filter({"$nor": [{"c_acctbal": {"$lt": 0}}, {"c_nationkey": {"$in": [1, 2]}}]}, table(s, d, "customer").schema).alias("hit")), "SELECT c_custkey, NOT (c_acctbal < 0 OR c_nationkey IN (1, 2)) AS hit FROM customer")
add("index_sparse", lambda s, d: routing.unique_violations(_nulls(s, d).select("top"), ["top"], sparse=True), f"SELECT top, count(*) AS n FROM {_N} WHERE top IS NOT NULL GROUP BY top HAVING count(*) > 1")
add("display", lambda s, d: table(s, d, "part").select("p_partkey", values.display(F.col("p_name"), table(s, d, "part").schema["p_name"].dataType).alias("name"), values.display(F.col("p_size"), table(s, d, "part").schema["p_size"].dataType).alias("size")), "SELECT p_partkey, '\"' || p_name || '\"' AS name, CAST(p_size AS VARCHAR) AS size FROM part")
_CRC = "list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(strlen(n_name)), lambda i: CAST('0x' || substr(hex(encode(n_name)), 2 * i + 1, 2) AS UBIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)))"
add("crc32", lambda s, d: table(s, d, "nation").select("n_nationkey", values.crc32(F.col("n_name")).alias("c")), f"SELECT n_nationkey, CAST(xor({_CRC}, 4294967295::UBIGINT) AS BIGINT) AS c FROM nation")
add("set_path", lambda s, d: _props(s, d).select("event_id", values.set_path(F.col("props"), "k", 7).getField("k").alias("k")), "SELECT event_id, 7 AS k FROM events")


# --- order, nested updates and wider columns -----------------------------------------------------
def _pushed(name: str, sort: dict, between: list[dict], sql_order: str) -> None:
    stages = [{"$sort": sort}, *between, {"$group": {"_id": "$o_custkey", "keys": {"$push": "$o_orderkey"}, "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_orderkey"}}}]
    add(
        name,
        lambda s, d: aggregate(table(s, d, "orders"), stages),
        f"SELECT o_custkey AS _id, list(o_orderkey ORDER BY {sql_order}) AS keys, list(o_orderkey ORDER BY {sql_order})[1] AS first, list(o_orderkey ORDER BY {sql_order})[-1] AS last FROM orders GROUP BY 1",
    )


_pushed("p_push_descending_text", {"o_orderpriority": -1, "o_orderkey": 1}, [], "o_orderpriority DESC, o_orderkey")
_pushed("p_push_projected", {"o_orderstatus": -1, "o_totalprice": -1, "o_orderkey": 1}, [{"$project": {"o_custkey": 1, "o_orderkey": 1}}, {"$match": {}}], "o_orderstatus DESC, o_totalprice DESC, o_orderkey")
add(
    "p_first_null",
    lambda s, d: aggregate(_nulls(s, d).withColumn("g", F.col("c_custkey") % 7), [{"$sort": {"top": -1, "c_custkey": 1}}, {"$group": {"_id": "$g", "first": {"$first": "$c_custkey"}, "last": {"$last": "$c_custkey"}, "top": {"$first": "$top"}}}]),
    f"WITH x AS (SELECT *, c_custkey % 7 AS g, row_number() OVER (ORDER BY top DESC NULLS FIRST, c_custkey) AS r FROM {_N}) SELECT g AS _id, arg_min(c_custkey, r) AS first, arg_max(c_custkey, r) AS last, arg_min_null(top, r) AS top FROM x GROUP BY g",
)
add("p_push_input_order", lambda s, d: aggregate(table(s, d, "nation"), [{"$group": {"_id": "$n_regionkey", "names": {"$push": "$n_name"}}}]), "SELECT n_regionkey AS _id, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
add(
    "p_push_unwound",
    lambda s, d: aggregate(_turns(s, d), [{"$sort": {"conv_id": 1}}, {"$unwind": "$turns"}, {"$project": {"role": "$turns.role", "n": "$turns.n"}}, {"$group": {"_id": "$role", "sizes": {"$push": "$n"}}}]),
    "SELECT role AS _id, list(length(text) ORDER BY conv_id, turn, role, length(text)) AS sizes FROM conversations GROUP BY 1",
)


def _info(df: DataFrame) -> DataFrame:
    return df.select("c_custkey", "c_mktsegment", F.struct("c_name", F.col("c_nationkey").alias("n"), F.array(F.lit("a"), "c_mktsegment").alias("tags"), F.struct(F.lit(1).alias("x")).alias("in")).alias("info"))


def _nested(name: str, update: dict, take: list, sql: str) -> None:
    add(name, lambda s, d: apply_update(_info(table(s, d, "customer")), {"c_mktsegment": "BUILDING"}, update).selectExpr("c_custkey", *take), f"SELECT c_custkey, {sql} FROM customer")


_nested("u_nested_set", {"$set": {"info.c_name": "x", "info.in.x": 9}}, ["info.c_name", "info.`in`.x AS x", "info.n"], f"CASE WHEN {_W} THEN 'x' ELSE c_name END AS c_name, CASE WHEN {_W} THEN 9 ELSE 1 END AS x, c_nationkey AS n")
_nested("u_nested_new", {"$set": {"info.in.y": "z", "other.deep.v": 5}}, ["info.`in`.x AS x", "info.`in`.y AS y", "other.deep.v AS v"], f"1 AS x, CASE WHEN {_W} THEN 'z' END AS y, CASE WHEN {_W} THEN 5 END AS v")
_nested("u_nested_unset", {"$unset": {"info.c_name": "", "info.absent": ""}}, ["info.c_name", "info.n"], f"CASE WHEN NOT {_W} THEN c_name END AS c_name, c_nationkey AS n")
_nested("u_nested_inc", {"$inc": {"info.n": 0.5}}, ["info.n"], f"CASE WHEN {_W} THEN c_nationkey + 0.5::DOUBLE ELSE c_nationkey::DOUBLE END AS n")
_nested("u_nested_push", {"$push": {"info.tags": "t"}}, ["info.tags"], f"CASE WHEN {_W} THEN ['a', c_mktsegment, 't'] ELSE ['a', c_mktsegment] END AS tags")
_nested("u_nested_pull", {"$pull": {"info.tags": "a"}}, ["info.tags"], f"CASE WHEN {_W} THEN [c_mktsegment] ELSE ['a', c_mktsegment] END AS tags")
_nested("u_nested_rename", {"$rename": {"info.c_name": "info.in.name"}}, ["info.c_name", "info.`in`.name AS name"], f"CASE WHEN NOT {_W} THEN c_name END AS c_name, CASE WHEN {_W} THEN c_name END AS name")
_update("u_set_wider", {"$set": {"c_nationkey": 1.5}}, f"* REPLACE (CASE WHEN {_W} THEN 1.5::DOUBLE ELSE c_nationkey::DOUBLE END AS c_nationkey)")
_filter("f_regex_unicode", "customer", {"c_name": {"$regex": r"^\p{L}+#"}}, C, r"regexp_matches(c_name, '^\p{L}+#')")


# --- collections, databases and commands ---------------------------------------------------------
def _collection(s: SparkSession, d: str, tab: str = "customer", key: str = "c_custkey", **kw) -> Collection:
    """A new collection of a table's rows, in two inserts, under their keys."""
    c = Database(s, _fresh(s)).create_collection(tab, **kw)
    rows = table(s, d, tab).withColumn("_id", F.col(key).cast("string"))
    c.insert_many(rows.where(F.col(key) % 2 == 0))
    c.insert_many(rows.where(F.col(key) % 2 == 1))
    return c


def _after(s: SparkSession, d: str, *changes_: Callable[[Collection], object], cols: tuple = ("c_name", "c_acctbal", "_version"), **kw) -> DataFrame:
    """A collection after changes to it, errors of the engine among them, as another process finds it."""
    c = _collection(s, d, **kw)
    for change in changes_:
        try:
            change(c)
        except (CapacityError, DuplicateKeyError, ValidationError, ConflictError):
            pass
    return Collection(s, c.path).df().select("_id", *cols)


_CC = "CAST(c_custkey AS VARCHAR) AS _id"
_KEPT = f"SELECT {_CC}, c_name, c_acctbal, CAST(1 AS BIGINT) AS _version FROM customer"
add("c_insert_many", lambda s, d: _after(s, d), _KEPT)
add("c_insert_one", lambda s, d: _after(s, d, lambda c: c.insert_one({"_id": "new", "c_name": "n", "c_acctbal": 1.5})), f"{_KEPT} UNION ALL SELECT 'new', 'n', 1.5, 1")
add("c_update_many", lambda s, d: _after(s, d, lambda c: c.update_many({"c_mktsegment": "BUILDING"}, {"$set": {"c_name": "x"}})), f"SELECT {_CC}, CASE WHEN {_W} THEN 'x' ELSE c_name END AS c_name, c_acctbal, CAST(CASE WHEN {_W} THEN 2 ELSE 1 END AS BIGINT) AS _version FROM customer")
add("c_update_one", lambda s, d: _after(s, d, lambda c: c.update_many({"_id": "8"}, {"$inc": {"c_acctbal": 0.5}})), f"SELECT {_CC}, c_name, CASE WHEN c_custkey = 8 THEN c_acctbal + 0.5 ELSE c_acctbal END AS c_acctbal, CAST(CASE WHEN c_custkey = 8 THEN 2 ELSE 1 END AS BIGINT) AS _version FROM customer")
add("c_replace_one", lambda s, d: _after(s, d, lambda c: c.replace_one("9", {"c_name": "r"})), f"SELECT {_CC}, CASE WHEN c_custkey = 9 THEN 'r' ELSE c_name END AS c_name, CASE WHEN c_custkey <> 9 THEN c_acctbal END AS c_acctbal, CAST(CASE WHEN c_custkey = 9 THEN 2 ELSE 1 END AS BIGINT) AS _version FROM customer")
add("c_delete_many", lambda s, d: _after(s, d, lambda c: c.delete_many({"c_acctbal": {"$lt": 0}})), f"{_KEPT} WHERE NOT c_acctbal < 0")
add("c_delete_one", lambda s, d: _after(s, d, lambda c: c.delete_many({"_id": "10"})), f"{_KEPT} WHERE c_custkey <> 10")
add("c_capped", lambda s, d: _after(s, d, lambda c: c.create(cap=c.count()), lambda c: c.insert_one({"c_name": "over"})), _KEPT)
add("c_capped_bytes", lambda s, d: _after(s, d, lambda c: c.create(cap_bytes=1), lambda c: c.insert_one({"c_name": "over"})), _KEPT)
add("c_unique", lambda s, d: _after(s, d, lambda c: c.create_index("name", ["c_name"], unique=True), lambda c: c.insert_one({"c_name": c.find().first()["c_name"]}), lambda c: c.update_many({}, {"$set": {"c_name": "one"}})), _KEPT)
add("c_validated", lambda s, d: _after(s, d, lambda c: c.insert_many(s.createDataFrame([(5,)], "c_name int")), schema=validate.Schema({"c_name": validate.Field("string", required=True)})), _KEPT)
add("c_checkpoint", lambda s, d: _after(s, d, lambda c: c.update_many({"_id": "4"}, {"$set": {"c_name": "x"}}), lambda c: c.checkpoint(), lambda c: c.vacuum()), f"SELECT {_CC}, CASE WHEN c_custkey = 4 THEN 'x' ELSE c_name END AS c_name, c_acctbal, CAST(CASE WHEN c_custkey = 4 THEN 2 ELSE 1 END AS BIGINT) AS _version FROM customer")


def _expiring(s: SparkSession, d: str) -> DataFrame:
    c = Database(s, _fresh(s)).create_collection("orders")
    c.insert_many(table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit("1995-01-01").cast("timestamp")).when(F.col("o_orderkey") % 3 == 1, F.lit("9995-01-01").cast("timestamp")).alias("_expires_at")))
    return c.find(projection=["o_orderkey"])


add("ttl", _expiring, "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")


def _reopened(s: SparkSession, d: str) -> DataFrame:
    at = _fresh(s)
    for name in ("nation", "region", "gone"):
        Database(s, at).create_collection(name)
    Database(s, at).collection("nation").insert_many(table(s, d, "nation"))
    Database(s, at).drop_collection("gone")
    db = Database(s, at)
    return s.createDataFrame([(n, db.exists(n), k) for n, k in db.stats().items()], "name string, there boolean, n bigint")


add("c_databases", _reopened, "SELECT 'nation' AS name, true AS there, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'region', true, 0")
add("c_find_by_id", lambda s, d: s.createDataFrame([(_collection(s, d).find_by_id("12")["c_name"],)], "c_name string"), "SELECT c_name FROM customer WHERE c_custkey = 12")


def _cursor(s: SparkSession, d: str) -> DataFrame:
    c, rows, k = Cursor(find(table(s, d, "nation"), {}, sort=[("n_nationkey", True)]), 10), [], 0
    while c.has_next():
        rows += [(k, r["n_nationkey"]) for r in c.next_batch()]
        k += 1
    return s.createDataFrame(rows, "batch int, n_nationkey int")


add("find_cursor", _cursor, "SELECT CAST(n_nationkey // 10 AS INTEGER) AS batch, n_nationkey FROM nation")
add("find_explain", lambda s, d: s.createDataFrame([(lambda e: (e["strategy"], e["pushed"], e["limit"]))(explain(table(s, d, "customer"), {"c_custkey": {"$gt": 5}}, limit=3))], "strategy string, pushed boolean, most int"), "SELECT 'scan' AS strategy, true AS pushed, 3 AS most")


def _wire(s: SparkSession, d: str) -> DataFrame:
    """A session of commands from insert to aggregate, malformed ones among them; a row a command."""
    x, out = Commands(s, _fresh(s)).execute, []
    nations = [{"_id": str(r["n_nationkey"]), "k": r["n_nationkey"], "region": r["n_regionkey"], "name": r["n_name"]} for r in table(s, d, "nation").collect()]
    run = lambda kind, **c: out.append((len(out), kind, (r := x({"type": kind} | c))["ok"], str(r.get("data")) if r["ok"] else "error"))
    run("insert_many", collection="n", documents=nations)
    run("count", collection="n", filter={"region": 1})
    run("find", collection="n", filter={"region": {"$gte": 3}}, sort=[["k", False]], limit=1, projection=["k"])
    run("update_many", collection="n", filter={"region": 0}, update={"$inc": {"k": 100}})
    run("delete_many", collection="n", filter={"k": {"$gte": 100}})
    run("aggregate", collection="n", pipeline=[{"$group": {"_id": None, "n": {"$sum": 1}}}, {"$project": {"n": 1}}])
    run("find")
    run("nothing")
    run("create_index", collection="n", name="u", fields=["name"], unique=True)
    run("insert_one", collection="n", document={"name": nations[-1]["name"]})
    run("list_collections")
    return s.createDataFrame(out, "step int, kind string, ok boolean, data string")


add(
    "w_commands",
    _wire,
    """SELECT * FROM (VALUES (0, 'insert_many', true, (SELECT CAST(count(*) AS VARCHAR) FROM nation)), (1, 'count', true, (SELECT CAST(count(*) AS VARCHAR) FROM nation WHERE n_regionkey = 1)),
    (2, 'find', true, (SELECT '[{''k'': ' || max(n_nationkey) || '}]' FROM nation WHERE n_regionkey >= 3)), (3, 'update_many', true, (SELECT CAST(count(*) AS VARCHAR) FROM nation WHERE n_regionkey = 0)),
    (4, 'delete_many', true, (SELECT CAST(count(*) AS VARCHAR) FROM nation WHERE n_regionkey = 0)), (5, 'aggregate', true, (SELECT '[{''n'': ' || CAST(count(*) AS DOUBLE) || '}]' FROM nation WHERE n_regionkey <> 0)),
    (6, 'find', false, 'error'), (7, 'nothing', false, 'error'), (8, 'create_index', true, 'None'), (9, 'insert_one', false, 'error'), (10, 'list_collections', true, '[''n'']')) t(step, kind, ok, data)""",
)


def _transactions(s: SparkSession, d: str) -> DataFrame:
    """Two transactions that write one document, of which the second fails, and one that is given up."""
    at = _fresh(s)
    db = Database(s, at)
    db.create_collection("t").insert_many(table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("_id"), "n_name"))
    x = Commands(s, at).execute
    a, b, c = (x({"type": "txn_begin"})["data"] for _ in range(3))
    op = lambda t, **k: x({"type": "txn_op", "txn_id": t, "collection": "t"} | k)
    op(a, op="update", id="1", update={"$set": {"n_name": "a"}})
    op(a, op="insert", id="n1", document={"n_name": "new"})
    op(a, op="delete", id="2")
    op(b, op="update", id="1", update={"$set": {"n_name": "b"}})
    op(c, op="delete", id="3")
    for kind, t in (("txn_commit", a), ("txn_commit", b), ("txn_abort", c)):
        x({"type": kind, "txn_id": t})
    return Database(s, at).collection("t").df().select("_id", "n_name", "_version")


add("txn_apply", _transactions, "SELECT CAST(n_nationkey AS VARCHAR) AS _id, CASE WHEN n_nationkey = 1 THEN 'a' ELSE n_name END AS n_name, CAST(CASE WHEN n_nationkey = 1 THEN 2 ELSE 1 END AS BIGINT) AS _version FROM nation WHERE n_nationkey <> 2 UNION ALL SELECT 'n1', 'new', 1")


def _out(s: SparkSession, d: str) -> DataFrame:
    at = _fresh(s)
    db = Database(s, at)
    sink = lambda name, df: db.create_collection(name).insert_many(df)
    aggregate(table(s, d, "nation"), [{"$match": {"n_regionkey": 1}}, {"$out": "some"}], sink=sink)
    return Database(s, at).collection("some").df().select("n_nationkey", "n_name")


add("p_out_collection", _out, "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")


# --- logs, versions and feeds on disk ------------------------------------------------------------
def _wal(s: SparkSession, d: str) -> DataFrame:
    """A log in two appends with transactions of which every third isn't committed, read with its checksums and recovered."""
    at, e = _fresh(s), table(s, d, "events")
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "insert").otherwise("update")
    rows = e.select(F.col("event_id").alias("seq"), op.alias("op"), F.lit("c").alias("collection"), F.col("user_id").cast("string").alias("doc_id"), (F.col("event_id") % 50).alias("txn_id"), F.col("value").cast("string").alias("data"))
    middle = e.agg(F.max("event_id")).first()[0] // 2
    versions.log_append(s, at, rows.where(F.col("seq") <= middle))
    versions.log_append(s, at, rows.where(F.col("seq") > middle))
    none = F.lit(None).cast("string")
    commits = s.range(50).where("id % 3 <> 0").select(F.col("id").alias("seq"), F.lit("txn_commit").alias("op"), none.alias("collection"), none.alias("doc_id"), F.col("id").alias("txn_id"), none.alias("data"))
    versions.log_append(s, at, commits)
    return versions.recover(versions.log_read(s, at)).select("doc_id", F.col("data").cast("double").alias("value"))


add("wal_recover", _wal, "SELECT CAST(user_id AS VARCHAR) AS doc_id, value FROM (SELECT * FROM events WHERE event_id % 50 % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'")
add("mvcc_write", lambda s, d: versions.put_version(_versions(s, d), s.range(20).select(F.col("id").alias("doc_id"), F.lit(-1.0).alias("value"), F.lit(False).alias("deleted")), 99).where("txn_id = 99").select("doc_id", "version", "value"), "SELECT r.i AS doc_id, coalesce(v, 0) + 1 AS version, -1.0::DOUBLE AS value FROM (SELECT unnest(range(20)) AS i) r LEFT JOIN (SELECT user_id, max(event_id) AS v FROM events GROUP BY 1) ON user_id = r.i")
add("oplog_append", lambda s, d: versions.oplog_append(table(s, d, "events").select("event_id", "event_type"), s.createDataFrame([(1, "x"), (2, "y")], "event_id bigint, event_type string"), 10, "event_id"), "SELECT * FROM (SELECT event_id, event_type FROM events UNION ALL SELECT (SELECT max(event_id) FROM events) + i, t FROM (VALUES (1, 'x'), (2, 'y')) n(i, t)) ORDER BY event_id DESC LIMIT 10")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """The feed as a stream of files: filtered without state, delivered from a checkpoint, twice."""
    at = _fresh(s)
    feed = _feed(s, d)
    middle = feed.agg(F.max("cluster_time")).first()[0] // 2
    for part in (feed.where(F.col("cluster_time") <= middle), feed.where(F.col("cluster_time") > middle)):
        part.write.mode("append").parquet(f"{at}/in")
        changes.deliver(changes.watch(changes.source(s, f"{at}/in", feed.schema), "db.ab", ["insert", "delete"]), f"{at}/out", f"{at}/checkpoint")
    return s.read.parquet(f"{at}/out").select("id", "cluster_time")


add("change_stream", _streamed, "SELECT CAST(event_id AS VARCHAR) AS id, event_id AS cluster_time FROM events WHERE user_id % 2 <> 0 AND event_type <> 'view'")


def _pulled(s: SparkSession, d: str) -> DataFrame:
    """A feed pulled in batches, and once more after its first batch's resume token."""
    feed = changes.ChangeFeed(s, _fresh(s))
    stream = feed.open("db.n", ["insert"])
    feed.broadcast([{"change_type": "insert" if r["n_nationkey"] % 2 == 0 else "update", "namespace": "db.nation", "document_id": str(r["n_nationkey"])} for r in table(s, d, "nation").orderBy("n_nationkey").collect()])
    feed.emit("drop", "db.other")
    rows = [(1, r["document_id"], r["cluster_time"]) for r in feed.next_batch(stream, 5)]
    again = feed.open("db.n", ["insert"], resume_after=stream.resume_token)
    rows += [(2, r["document_id"], r["cluster_time"]) for r in feed.next_batch(again, 100)]
    feed.close(again)
    return s.createDataFrame(rows, "batch int, document_id string, cluster_time bigint")


add("change_pull", _pulled, "SELECT CASE WHEN n_nationkey < 10 THEN 1 ELSE 2 END AS batch, CAST(n_nationkey AS VARCHAR) AS document_id, CAST(n_nationkey + 1 AS BIGINT) AS cluster_time FROM nation WHERE n_nationkey % 2 = 0")


# --- stored text, places and small structures ----------------------------------------------------
def _built(s: SparkSession, d: str) -> DataFrame:
    """A text index of all documents and terms, built from nothing; its postings folded by term."""
    index = search.TextIndexes(s, _fresh(s)).create_index(table(s, d, "documents"), "documents", "text", "doc_id", ["text"])
    return index.postings().groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.sum(F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("places"))


add("t_build", _built, f"WITH {_TOK} SELECT term, count(DISTINCT doc) AS df, count(*) AS cf, CAST(sum(pos) AS BIGINT) AS places FROM tok GROUP BY 1")


def _grid(s: SparkSession, d: str) -> geo.GridIndex:
    at = _stored(s, d, "customer", "grid")
    return geo.GridIndex(s, at) if scratch.exists(s, f"{at}/meta.json") else geo.GridIndex.build(_points(s, d), at)


add("g_index_near", lambda s, d: _grid(s, d).near(-179.5, 80.0, 3e6, 1e6).select("c_custkey"), f"SELECT c_custkey FROM {_P} WHERE {_hav(-179.5, 80.0)} BETWEEN 1e6 AND 3e6")
add("g_index_date_line", lambda s, d: _grid(s, d).near(179.0, -20.0, 1.5e6).select("c_custkey"), f"SELECT c_custkey FROM {_P} WHERE {_hav(179.0, -20.0)} <= 1.5e6")
add("g_index_box", lambda s, d: _grid(s, d).within_box(-10, 35, 30, 60).select("c_custkey", F.round("distance", 1).alias("m")), f"SELECT c_custkey, round({_hav(10.0, 47.5)}, 1) AS m FROM {_P} WHERE lon BETWEEN -10 AND 30 AND lat BETWEEN 35 AND 60")
add("g_index_polygon", lambda s, d: _grid(s, d).within_polygon(_RING).select("c_custkey"), f"SELECT c_custkey FROM {_P} WHERE {_ray(_RING)}")
add("g_circle", lambda s, d: geo.within(_points(s, d), geo.Circle(-179.0, 60.0, 2e6)).select("c_custkey"), f"SELECT c_custkey FROM {_P} WHERE {_hav(-179.0, 60.0)} <= 2e6")
_HOLE = ((0.05, 40.05), (20.05, 40.05), (10.03, 50.05))
add("g_polygon_hole", lambda s, d: geo.within(_points(s, d), geo.Polygon(tuple(_RING), (_HOLE,))).select("c_custkey"), f"SELECT c_custkey FROM {_P} WHERE {_ray(_RING)} AND NOT {_ray(list(_HOLE))}")
add("g_units", lambda s, d: _points(s, d).select("c_custkey", F.round(geo.degrees_to_meters(F.col("lat")), 3).alias("m"), F.round(geo.meters_to_degrees(geo.degrees_to_meters(F.col("lat"))), 6).alias("deg")), f"SELECT c_custkey, round(lat * 111320, 3) AS m, round(lat, 6) AS deg FROM {_P}")
add("g_boxes", lambda s, d: s.createDataFrame([(geo.boxes_intersect((0, 0, 2, 2), (2, 2, 3, 3)), geo.boxes_intersect((0, 0, 2, 2), (2.5, 0, 3, 3)), *geo.box_center(-10, 35, 30, 60))], "touching boolean, apart boolean, lon double, lat double"), "SELECT true AS touching, false AS apart, 10.0::DOUBLE AS lon, 47.5::DOUBLE AS lat")


def _replicas(s: SparkSession, d: str) -> DataFrame:
    r = replication.ReplicaSet("rs", "a")
    for i, role in (("a", "primary"), ("b", "secondary"), ("c", "arbiter")):
        r.add(replication.Member(i, f"host-{i}", 7000, role))
    r.heartbeat("a", 40)
    r.heartbeat("b", 33)
    return r.status(s)


add("replicas", _replicas, "SELECT 'rs' AS set, i AS id, 'host-' || i || ':7000' AS host, r AS role, true AS healthy, CAST(ts AS BIGINT) AS oplog_ts, CAST(40 - ts AS BIGINT) AS lag FROM (VALUES ('a', 'primary', 40), ('b', 'secondary', 33), ('c', 'arbiter', 0)) t(i, r, ts)")


def _lru(s: SparkSession, d: str) -> DataFrame:
    """Regions asked of a cache of two, in turn and again."""
    c, rows = cache.LruCache(2), []
    for r in [*table(s, d, "region").orderBy("r_regionkey").collect()] * 2:
        rows.append((len(rows), c.get(r["r_regionkey"]) is not None))
        c.put(r["r_regionkey"], r["r_name"])
        c.get(0)
    return s.createDataFrame(rows, "step int, hit boolean")


add("lru_cache", _lru, "SELECT CAST(i AS INTEGER) AS step, i % 5 = 0 AND i > 0 AS hit FROM (SELECT unnest(range(10)) AS i)")
add("generate_id", lambda s, d: table(s, d, "nation").select(values.generate_id().alias("i")).agg(F.count_distinct("i").alias("n"), F.min(F.col("i").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("fits")), "SELECT count(*) AS n, true AS fits FROM nation")
add("now_millis", lambda s, d: s.range(1).select(values.now_millis().alias("t")).select((F.abs(F.col("t") - F.unix_millis(F.current_timestamp())) < 60_000).alias("now")), "SELECT true AS now")
add("coercions", lambda s, d: table(s, d, "customer").select("c_custkey", values.as_number(F.col("c_nationkey"), table(s, d, "customer").schema["c_nationkey"].dataType).alias("n"), values.as_number(F.col("c_name"), table(s, d, "customer").schema["c_name"].dataType).alias("no_n"), values.as_text(F.col("c_name"), table(s, d, "customer").schema["c_name"].dataType).alias("t"), values.as_text(F.col("c_nationkey"), table(s, d, "customer").schema["c_nationkey"].dataType).alias("no_t")), "SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS no_n, c_name AS t, CAST(NULL AS VARCHAR) AS no_t FROM customer")
_TRUTHS = lambda df: df.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("t"), F.array_repeat(F.lit(1), (F.col("c_custkey") % 2).cast("int")).alias("a"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") > 0).alias("b"), (F.col("c_custkey") % 4 / 2).alias("x"))


def _truthy(s: SparkSession, d: str) -> DataFrame:
    df = _TRUTHS(table(s, d, "customer"))
    return df.select("c_custkey", *[values.is_truthy(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields[1:]])


add("truthy_kinds", _truthy, "SELECT c_custkey, c_custkey % 3 <> 0 AS t, c_custkey % 2 = 1 AS a, c_custkey % 5 <> 0 AND c_acctbal > 0 AS b, c_custkey % 4 <> 0 AS x FROM customer")
_pipe("p_lookup_documents", "region", [{"$lookup": {"from": "nation", "localField": "r_regionkey", "foreignField": "n_regionkey", "as": "nations"}}], "SELECT r_regionkey, list(n_name ORDER BY n_nationkey) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1", ("nation",), lambda df: df.select("r_regionkey", F.transform("nations", lambda n: n["n_name"]).alias("names")))
add("c_find_one", lambda s, d: s.createDataFrame([(Commands(s, (c := _collection(s, d, "nation", "n_nationkey")).path.rsplit("/", 2)[0]).execute({"type": "find_one", "collection": "nation", "filter": {"n_regionkey": 2}, "sort": [["n_nationkey", False]]})["data"]["n_name"],)], "n_name string"), "SELECT arg_max(n_name, n_nationkey) AS n_name FROM nation WHERE n_regionkey = 2")
