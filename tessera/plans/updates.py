"""Update language as a conditional projection of the whole collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryParseError
from ..functions import values as V
from .filters import compile_filter

OPERATORS = ("$set", "$unset", "$inc", "$push", "$pull", "$rename")


def parse_update(update: dict) -> list[tuple[str, str, object]]:
    """(operator, field, value) in written order; a bare key sets."""
    if not isinstance(update, dict):
        raise QueryParseError("an update must be an object")
    out: list[tuple[str, str, object]] = []
    for key, v in update.items():
        if key in OPERATORS:
            if not isinstance(v, dict):
                raise QueryParseError(f"{key} needs an object")
            out += [(key, f, x) for f, x in v.items() if key != "$rename" or isinstance(x, str)]
        else:
            out.append(("$set", key, v))
    return out


def apply_update(df: DataFrame, query: dict, update: dict, version_col: str | None = None) -> DataFrame:
    """``df`` after the update of matching rows. Each operator is one projection, which Catalyst collapses.

    A dotted path goes through documents and maps; $set, $inc and $push make documents that are
    missing on the way. A value that doesn't fit its column widens it (int to bigint to double);
    one of another kind is an error, as is a path through anything but documents.
    """
    df = df.withColumn(HIT, compile_filter(query, df.schema))
    hit = F.col(HIT)
    for op, path, v in parse_update(update):
        if op == "$rename":
            df = _renamed(df, path, v)
        elif op in MAKES or V.resolve(df.schema, path) is not None:
            df = _put(df, path.split("."), hit, lambda old, dt, op=op, v=v: _leaf(op, old, dt, v), op in MAKES)
    if version_col:
        df = df.withColumn(version_col, F.when(hit, F.col(version_col) + 1).otherwise(F.col(version_col)))
    return df.drop(HIT)


HIT = "_tsr_hit"
#: Operators that make what is missing on their path.
MAKES = ("$set", "$inc", "$push")


def _renamed(df: DataFrame, path: str, to: str) -> DataFrame:
    at = V.resolve(df.schema, path)
    if at is None or path == to:
        return df
    value, dt = at
    df = df.withColumns({"_tsr_value": value, "_tsr_has": F.col(HIT) & value.isNotNull()})

    def assign(old, kind):
        if kind is not None and kind != dt:
            raise QueryParseError(f"$rename of a {dt.simpleString()} to a {kind.simpleString()}")
        return F.col("_tsr_value")

    df = _put(df, to.split("."), F.col("_tsr_has"), assign, True)
    df = _put(df, path.split("."), F.col("_tsr_has"), lambda old, kind: F.lit(None).cast(kind), False)
    return df.drop("_tsr_value", "_tsr_has")


def _put(df: DataFrame, path: list[str], hit: Column, leaf: Callable, makes: bool) -> DataFrame:
    head = path[0]
    old, dt = (F.col(f"`{head}`"), df.schema[head].dataType) if head in df.columns else (None, None)
    return df.withColumn(head, _rebuilt(old, dt, path[1:], hit, leaf, makes))


def _rebuilt(old: Column | None, dt: T.DataType | None, rest: list[str], hit: Column, leaf: Callable, makes: bool) -> Column:
    """A column with ``leaf`` applied at a path below it in rows that are hit; every document on the way is rebuilt."""
    if not rest:
        new = leaf(old, dt)
        return F.when(hit, new).otherwise(old) if old is not None else F.when(hit, new)
    name, *below = rest
    if dt is None:
        return F.when(hit, F.struct(_rebuilt(None, None, below, hit, leaf, makes).alias(name)))
    if isinstance(dt, T.MapType):
        inner = _rebuilt(F.try_element_at(old, F.lit(name)), dt.valueType, below, hit, leaf, makes)
        base = F.coalesce(old, F.create_map().cast(dt)) if makes else old
        others = F.map_filter(base, lambda k, _: k != name)
        return F.when(hit & base.isNotNull(), F.map_filter(F.map_concat(others, F.create_map(F.lit(name), inner)), lambda _, x: x.isNotNull())).otherwise(old)
    if not isinstance(dt, T.StructType):
        raise QueryParseError(f"{name} is below a {dt.simpleString()}")
    inner = _rebuilt(*((old.getField(name), dt[name].dataType) if name in dt.names else (None, None)), below, hit, leaf, makes)
    parts = [(inner if n == name else old.getField(n)).alias(n) for n in dt.names]
    whole = F.struct(*parts, *([] if name in dt.names else [inner.alias(name)]))
    return F.when(old.isNotNull() | hit if makes else old.isNotNull(), whole)


def _leaf(op: str, old: Column | None, dt: T.DataType | None, v) -> Column:
    """The value that an operator gives in a row that it hits."""
    if op == "$unset":
        return F.lit(None).cast(dt)
    if op == "$set":
        return literal(v) if dt is None or v is None else literal(v, fitted(dt, v))
    if op == "$inc":
        if isinstance(v, bool) or not isinstance(v, (int, float)) or (dt is not None and V.column_tag(dt) not in V.NUMERIC):
            raise QueryParseError("$inc adds numbers to numbers")
        return F.lit(v) if dt is None else F.coalesce(old, F.lit(0)) + F.lit(v)
    if dt is not None and not isinstance(dt, T.ArrayType):
        raise QueryParseError(f"{op} needs an array")
    if op == "$push":
        if dt is None:
            return F.array(literal(v))
        kind = dt.elementType if v is None else fitted(dt.elementType, v)
        base = old if kind == dt.elementType else old.cast(T.ArrayType(kind))
        return F.array_append(F.coalesce(base, F.array().cast(T.ArrayType(kind))), literal(v, kind))
    return F.filter(old, lambda x: ~F.coalesce(V.equals(x, dt.elementType, v), F.lit(False)))


def fitted(dt: T.DataType, v) -> T.DataType:
    """The least type that holds a column's values and ``v``; an error where there is none."""
    tag, lit_tag = V.column_tag(dt), V.literal_tag(v)
    if tag in V.NUMERIC and lit_tag in V.NUMERIC:
        if lit_tag == "double":
            return dt if isinstance(dt, T.DoubleType) else T.DoubleType()
        if tag == "double":
            return dt if isinstance(dt, T.DoubleType) else T.DoubleType()
        return T.LongType() if lit_tag == "int64" else dt if isinstance(dt, T.LongType) else T.IntegerType()
    if isinstance(dt, T.ArrayType) and lit_tag == "array":
        kind = dt.elementType
        for x in v:
            kind = kind if x is None else fitted(kind, x)
        return T.ArrayType(kind)
    if isinstance(dt, T.StructType) and lit_tag == "document":
        if not set(v) <= set(dt.names):
            raise QueryParseError(f"fields {sorted(set(v) - set(dt.names))} aren't in {dt.simpleString()}")
        return T.StructType([T.StructField(f.name, f.dataType if v.get(f.name) is None else fitted(f.dataType, v[f.name])) for f in dt.fields])
    if isinstance(dt, T.MapType) and lit_tag == "document":
        kind = dt.valueType
        for x in v.values():
            kind = kind if x is None else fitted(kind, x)
        return T.MapType(dt.keyType, kind)
    if tag != lit_tag and not (tag == "null" or lit_tag == "null"):
        raise QueryParseError(f"a {lit_tag} doesn't fit a {dt.simpleString()}")
    return dt


def literal(v, dt: T.DataType | None = None) -> Column:
    """A value as a Column, documents and arrays included, in a type if one is given."""
    if isinstance(v, dict):
        if isinstance(dt, T.MapType):
            return F.create_map(*[c for k, x in v.items() for c in (F.lit(k), literal(x, dt.valueType))]).cast(dt)
        names = dt.names if dt is not None else sorted(v)
        return F.struct(*[literal(v.get(n), dt[n].dataType if dt is not None else None).alias(n) for n in names])
    if isinstance(v, (list, tuple)):
        out = F.array(*[literal(x, dt.elementType if dt is not None else None) for x in v])
    else:
        out = F.lit(v)
    return out if dt is None else out.cast(dt)


def delete_many(df: DataFrame, query: dict) -> DataFrame:
    return df.where(~compile_filter(query, df.schema))
