"""Filter language: JSON to an expression tree to a Catalyst Column.

Two dialects: the filter dialect, and the simpler wire dialect without logical operators.
Every leaf is two-valued, so that negation never meets a null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryParseError
from ..functions import values as V


@dataclass(frozen=True)
class All:
    pass


@dataclass(frozen=True)
class Leaf:
    op: str
    path: str
    value: Any


@dataclass(frozen=True)
class Element:
    path: str
    inner: Any


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    inner: Any


COMPARE = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte")
KNOWN = (*COMPARE, "$in", "$nin", "$exists", "$regex", "$type", "$elemMatch")


def parse(query: dict):
    """The tree of a filter in the filter dialect."""
    if not isinstance(query, dict):
        raise QueryParseError("a filter must be an object")
    parts = []
    for key, v in query.items():
        if key in ("$and", "$or", "$nor"):
            if not isinstance(v, list):
                raise QueryParseError(f"{key} needs an array")
            inner = tuple(parse(x) for x in v)
            parts.append(And(inner) if key == "$and" else Or(inner) if key == "$or" else Not(Or(inner)))
        elif key == "$not":
            parts.append(Not(parse(v)))
        else:
            parts.append(_field(key, v))
    return All() if not parts else parts[0] if len(parts) == 1 else And(tuple(parts))


def _field(path: str, v):
    if not isinstance(v, dict):
        return Leaf("$eq", path, v)
    if any(op not in KNOWN for op in v):
        return Leaf("$eq", path, v)
    parts = []
    for op, x in v.items():
        if op in ("$in", "$nin") and not isinstance(x, list):
            raise QueryParseError(f"{op} needs an array")
        if op == "$exists" and not isinstance(x, bool):
            raise QueryParseError("$exists needs a boolean")
        if op in ("$regex", "$type") and not isinstance(x, str):
            raise QueryParseError(f"{op} needs a string")
        parts.append(Element(path, parse(x)) if op == "$elemMatch" else Leaf(op, path, x))
    return parts[0] if len(parts) == 1 else And(tuple(parts))


def safe_pattern(p: str) -> bool:
    """Whether a pattern is linear, without look-around and back-references, and valid to the JVM, which runs it."""
    if re.search(r"\(\?[=!]|\(\?<[=!]|\\[1-9]|\(\?P=", p):
        return False
    context = SparkContext._active_spark_context
    try:
        context._jvm.java.util.regex.Pattern.compile(p) if context is not None else re.compile(p)
    except (Py4JJavaError, PySparkException, re.error):
        return False
    return True


def _root(schema: T.StructType) -> Callable:
    return lambda path: V.resolve(schema, path)


def _element(e: Column, dt: T.StructType) -> Callable:
    return lambda path: V.resolve(dt, path, lambda name: e.getField(name.strip("`")))


def compile_tree(node, find: Callable, coerce: bool = False, where: bool = False) -> Column:
    """The tree as a Column. With ``where`` a leaf may be null for false, as a WHERE takes it, and stays in a form that scans accept; below a negation leaves are two-valued."""
    sure = (lambda c: c) if where else (lambda c: F.coalesce(c, F.lit(False)))
    if isinstance(node, All):
        return F.lit(True)
    if isinstance(node, And):
        out = F.lit(True)
        for p in node.parts:
            out = out & compile_tree(p, find, coerce, where)
        return out
    if isinstance(node, Or):
        out = F.lit(False)
        for p in node.parts:
            out = out | compile_tree(p, find, coerce, where)
        return out
    if isinstance(node, Not):
        return ~compile_tree(node.inner, find, coerce)
    at = find(node.path)
    if isinstance(node, Element):
        if at is None or not isinstance(at[1], T.ArrayType) or not isinstance(at[1].elementType, T.StructType):
            return F.lit(False)
        kind = at[1].elementType
        return sure(F.exists(at[0], lambda e: e.isNotNull() & compile_tree(node.inner, _element(e, kind), coerce)))
    op, v = node.op, node.value
    if at is None:
        return F.lit(op in ("$ne", "$nin") or (op == "$exists" and not v))
    c, dt = at
    if op == "$eq":
        return sure(V.equals(c, dt, v, coerce))
    if op == "$ne":
        return c.isNull() | ~V.equals(c, dt, v, coerce) if where else ~sure(V.equals(c, dt, v, coerce))
    if op == "$in":
        return sure(_member(c, dt, v, coerce))
    if op == "$nin":
        hit = _member(c, dt, v, coerce)
        return c.isNull() | ~hit if where else ~sure(hit)
    if op == "$exists":
        return c.isNotNull() if v else c.isNull()
    if op == "$regex":
        return sure(c.rlike(v)) if V.column_tag(dt) == "string" and safe_pattern(v) else F.lit(False)
    if op == "$type":
        return sure(V.type_name(c, dt) == v)
    return sure(V.compares(op, c, dt, v))


def _member(c: Column, dt: T.DataType, vs: list, coerce: bool) -> Column:
    tag = V.column_tag(dt)
    if tag in ("array", "document"):
        out = F.lit(False)
        for v in vs:
            out = out | F.coalesce(V.equals(c, dt, v, coerce), F.lit(False))
        return out
    ok = {"int": ("int32", "int64")}.get(tag, (tag,))
    if coerce and tag in V.NUMERIC:
        ok = V.NUMERIC
    good = [v for v in vs if V.literal_tag(v) in ok]
    return c.isin(good) if good else F.lit(False)


def _wire(query: dict, schema: T.StructType, where: bool) -> Column:
    """The wire dialect: one level of fields, each with a literal or an object of operators."""
    out = F.lit(True)
    for path, v in query.items():
        at = None if path.startswith("$") else V.resolve(schema, path)
        if at is not None and any(s.isdigit() for s in path.split(".")[1:]):
            at = None
        if at is None:
            out = out & F.lit(not isinstance(v, dict) and v is None)
            continue
        c, dt = at
        if not isinstance(v, dict):
            hit = c.isNull() if v is None else V.equals(c, dt, v) if where else F.coalesce(V.equals(c, dt, v), F.lit(False))
        else:
            hit = c.isNotNull()
            for op, x in v.items():
                if op == "$exists":
                    hit = hit & F.lit(bool(x))
                elif op in ("$in", "$nin") and not isinstance(x, list):
                    hit = hit & F.lit(op == "$nin")
                elif op in (*COMPARE, "$in", "$nin") or (op == "$regex" and isinstance(x, str)):
                    hit = hit & compile_tree(Leaf(op, path, x), lambda _p, at=(c, dt): at, where=where)
        out = out & hit
    return out


def compile_filter(query: dict, schema: T.StructType, dialect: str = "filter", coerce: bool = False, where: bool = False) -> Column:
    """A filter as a Column over rows of ``schema``. ``coerce``: numbers are equal across types. ``where``: for use in a WHERE only."""
    if len({n.lower() for n in schema.names}) < len(schema.names):
        raise QueryParseError("column names differ only by case")
    if dialect == "wire":
        return _wire(query, schema, where)
    return compile_tree(parse(query), _root(schema), coerce, where)


def matches(query, row: dict) -> bool:
    """Row-at-a-time meaning of the filter dialect, for tests."""
    return _holds(parse(query), row)


_MISSING = object()


def _get(row, path: str):
    if path in row:
        return row[path] if row[path] is not None else _MISSING
    for seg in path.split("."):
        if isinstance(row, dict) and seg in row:
            row = row[seg]
        elif isinstance(row, list) and seg.isdigit() and int(seg) < len(row):
            row = row[int(seg)]
        else:
            return _MISSING
        if row is None:
            return _MISSING
    return row


def _holds(n, row: dict) -> bool:
    if isinstance(n, All):
        return True
    if isinstance(n, And):
        return all(_holds(p, row) for p in n.parts)
    if isinstance(n, Or):
        return any(_holds(p, row) for p in n.parts)
    if isinstance(n, Not):
        return not _holds(n.inner, row)
    x = _get(row, n.path)
    if isinstance(n, Element):
        return isinstance(x, list) and any(isinstance(e, dict) and _holds(n.inner, e) for e in x)
    same = lambda v: x is not _MISSING and V.literal_tag(x) == V.literal_tag(v) and x == v
    if n.op == "$eq":
        return same(n.value)
    if n.op == "$ne":
        return not same(n.value)
    if n.op == "$in":
        return any(same(v) for v in n.value)
    if n.op == "$nin":
        return not any(same(v) for v in n.value)
    if n.op == "$exists":
        return (x is not _MISSING) == n.value
    if x is _MISSING:
        return False
    if n.op == "$regex":
        return isinstance(x, str) and safe_pattern(n.value) and re.search(n.value, x) is not None
    if n.op == "$type":
        return V.literal_tag(x) == n.value
    a, b = V.literal_tag(x), V.literal_tag(n.value)
    if not ((a in V.NUMERIC and b in V.NUMERIC) or (a == b and a in V.ORDERED)):
        return False
    return {"$gt": x > n.value, "$gte": x >= n.value, "$lt": x < n.value, "$lte": x <= n.value}[n.op]
