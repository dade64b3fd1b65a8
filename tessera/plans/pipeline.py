"""Aggregation pipeline: each stage is a function from DataFrame to DataFrame, so Catalyst sees one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryParseError
from ..functions import values as V


@dataclass
class Context:
    """What stages need beside rows: other collections, a sink, and the hidden columns that hold the rows' order.

    ``wanted`` says that a later $group depends on order, so that it has to be kept.
    """

    collections: dict[str, DataFrame] = field(default_factory=dict)
    sink: Callable[[str, DataFrame], None] | None = None
    order: list[str] = field(default_factory=list)
    render_keys: bool = False
    wanted: bool = False

    def hidden(self) -> list[Column]:
        return [F.col(c) for c in self.order]


def _visible(df: DataFrame, ctx: Context) -> list[str]:
    return [c for c in df.columns if c not in ctx.order]


def numbered(df: DataFrame, ctx: Context) -> DataFrame:
    """``df`` with its rows' order in a hidden column: that of the scan, unless a stage has set another."""
    if ctx.order or not ctx.wanted:
        return df
    ctx.order = ["_tsr_order0"]
    return df.withColumn(ctx.order[0], F.monotonically_increasing_id())


def ordering(schema: T.StructType, keys) -> list[Column]:
    """Sort columns of (path, ascending) pairs or {path: 1 | -1}; missing values last ascending, first descending."""
    pairs = [(k, v if isinstance(v, bool) else v > 0) for k, v in (keys.items() if isinstance(keys, dict) else keys)]
    out = []
    for path, up in pairs:
        at = V.resolve(schema, path)
        if at is not None:
            out.append(at[0].asc_nulls_last() if up else at[0].desc_nulls_first())
    return out


def _path(text: str) -> str:
    return text[1:] if text.startswith("$") else text


def match(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """All top-level fields equal, by tag and value; no operators and no dotted paths."""
    for name, v in spec.items():
        hit = F.coalesce(V.equals(F.col(f"`{name}`"), df.schema[name].dataType, v), F.lit(False)) if name in df.columns else F.lit(False)
        df = df.where(hit)
    return df


def project(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """Inclusions and "$source" expressions choose columns; a projection of exclusions alone drops them."""
    drop = [k for k, v in spec.items() if v in (0, False)]
    take = [(k, v) for k, v in spec.items() if not (v in (0, False))]
    if not take:
        return df.drop(*drop)
    out = ctx.hidden()
    for name, v in take:
        at = V.resolve(df.schema, _path(v) if isinstance(v, str) else name)
        if at is not None:
            out.append(at[0].alias(name))
    return df.select(*out)


def accumulator(df: DataFrame, spec: dict, ctx: Context) -> Column:
    known = {k: v for k, v in spec.items() if k in ACCUMULATORS}
    if not known:
        raise QueryParseError(f"no accumulator in {spec}")
    op, arg = sorted(known.items())[-1]
    if op == "$count":
        return F.count(F.lit(1))
    if isinstance(arg, str):
        name = _path(arg)
        c, dt = (F.col(f"`{name}`"), df.schema[name].dataType) if name in df.columns else (F.lit(None).cast("double"), T.DoubleType())
    else:
        c, dt = F.lit(arg), T.DoubleType() if isinstance(arg, (int, float)) else T.StringType()
    return ACCUMULATORS[op](c, dt, ctx)


def _ordered(c: Column, ctx: Context) -> Column:
    return F.struct(*[h.alias(f"o{i}") for i, h in enumerate(ctx.hidden())], c.alias("v"))


ACCUMULATORS: dict[str, Callable[[Column, T.DataType, Context], Column]] = {
    "$sum": lambda c, dt, ctx: F.coalesce(F.sum(V.as_number(c, dt)), F.lit(0.0)),
    "$avg": lambda c, dt, ctx: F.avg(V.as_number(c, dt)),
    "$min": lambda c, dt, ctx: F.min(c),
    "$max": lambda c, dt, ctx: F.max(c),
    "$count": lambda c, dt, ctx: F.count(F.lit(1)),
    "$push": lambda c, dt, ctx: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), _ordered(c, ctx)))), lambda x: x["v"]),
    "$addToSet": lambda c, dt, ctx: F.array_sort(F.collect_set(c)),
    "$first": lambda c, dt, ctx: F.min_by(c, _ordered(F.lit(0), ctx)),
    "$last": lambda c, dt, ctx: F.max_by(c, _ordered(F.lit(0), ctx)),
}
_NEED_ORDER = ("$push", "$first", "$last")


def _needs_order(stage: dict) -> bool:
    spec = stage.get("$group")
    return isinstance(spec, dict) and any(op in _NEED_ORDER for n, s in spec.items() if n != "_id" and isinstance(s, dict) for op in s)


def group(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """Groups by null, a field or an object of fields; no row for no input. ``_id`` keeps native types unless keys are rendered.

    $push, $first and $last follow the order of the last $sort, stable among ties, or else that
    of the input's scan.
    """
    key = spec.get("_id")
    if key is None:
        k = F.lit(None).cast("string")
    elif isinstance(key, str):
        at = V.resolve(df.schema, _path(key))
        k = F.lit(None).cast("string") if at is None else V.display(*at) if ctx.render_keys else at[0]
    elif isinstance(key, dict):
        ats = [(n, V.resolve(df.schema, _path(p))) for n, p in sorted(key.items())]
        if ctx.render_keys:
            k = F.concat_ws("|", *[F.coalesce(V.display(*a), F.lit("null")) if a else F.lit("null") for _, a in ats])
        else:
            k = F.struct(*[(a[0] if a else F.lit(None).cast("string")).alias(n) for n, a in ats])
    else:
        raise QueryParseError("_id must be null, a field or an object of fields")
    outs = {n: s for n, s in spec.items() if n != "_id"}
    if _needs_order({"$group": spec}):
        ctx.wanted = True
        df = numbered(df, ctx)
    aggs = [accumulator(df, s, ctx).alias(n) for n, s in outs.items()]
    grouped = df.groupBy(k.alias("_id"))
    ctx.order = []
    return grouped.agg(*aggs) if aggs else grouped.agg(F.count(F.lit(1)).alias("_n")).drop("_n")


def sort(df: DataFrame, spec, ctx: Context) -> DataFrame:
    """Rows by the keys in turn, of any type that has an order.

    Where a later stage needs the order, rows are numbered after the sort: tasks hold ranges of
    it in turn, so the number is one comparable column whatever the keys' types and directions.
    """
    keys = ordering(df.schema, list(spec.items() if isinstance(spec, dict) else spec))
    if not keys:  # no document has any of them, so all are equal
        return numbered(df, ctx)
    if ctx.wanted:
        df = numbered(df, ctx)  # ties keep the order they came in
    out = df.orderBy(*keys, *ctx.hidden())
    if not ctx.wanted:
        return out
    out = out.withColumn("_tsr_sorted", F.monotonically_increasing_id()).drop(*ctx.order).withColumnRenamed("_tsr_sorted", "_tsr_order0")
    ctx.order = ["_tsr_order0"]
    return out


def limit(df: DataFrame, n, ctx: Context) -> DataFrame:
    return df.limit(n if isinstance(n, int) else 100)


def skip(df: DataFrame, n, ctx: Context) -> DataFrame:
    return df.offset(n if isinstance(n, int) else 0)


def unwind(df: DataFrame, spec, ctx: Context) -> DataFrame:
    """An array to a row an element. Rows without elements go, or stay with null where they are to be preserved."""
    path, keep = (_path(spec), False) if isinstance(spec, str) else (_path(spec["path"]), bool(spec.get("preserveNullAndEmptyArrays")))
    if path not in df.columns or not isinstance(df.schema[path].dataType, T.ArrayType):
        return df if keep else df.where(F.lit(False))
    c = F.col(f"`{path}`")
    if not ctx.wanted:
        return df.withColumn(path, F.explode_outer(c) if keep else F.explode(c))
    df, place = numbered(df, ctx), f"_tsr_order{len(ctx.order)}"
    out = df.select("*", (F.posexplode_outer(c) if keep else F.posexplode(c)).alias(place, "_tsr_element"))
    ctx.order = [*ctx.order, place]
    return out.withColumn(path, F.col("_tsr_element")).drop("_tsr_element")


def count(df: DataFrame, name: str, ctx: Context) -> DataFrame:
    ctx.order = []
    return df.agg(F.count(F.lit(1)).alias(name))


def add_fields(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in spec.items()})


def replace_root(df: DataFrame, spec, ctx: Context) -> DataFrame:
    at = V.resolve(df.schema, _path(spec["newRoot"] if isinstance(spec, dict) else spec))
    if at is None or not isinstance(at[1], T.StructType):
        raise QueryParseError("$replaceRoot needs a document field")
    return df.where(at[0].isNotNull()).select(*[at[0].getField(n).alias(n) for n in at[1].names], *ctx.hidden())


def lookup(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """Foreign documents of an equal key as an array, empty without any.

    Only foreign documents whose key some local row has are gathered: a semi-join with the
    distinct local keys comes first. They are grouped by key before the join, so a key meets one
    row; Catalyst chooses broadcast or sort-merge. A key's array is the result asked for, so its
    documents come together in one row whatever their number.
    """
    if spec["from"] not in ctx.collections:
        raise QueryParseError(f"$lookup from an unknown collection {spec['from']}")
    df = numbered(df, ctx)
    foreign = ctx.collections[spec["from"]]
    key, mine = V.resolve(foreign.schema, spec["foreignField"]), V.resolve(df.schema, spec["localField"])
    kind = T.ArrayType(foreign.schema)
    none = F.array().cast(kind)
    if key is None or mine is None:
        return df.withColumn(spec["as"], none)
    rows = foreign.select(key[0].alias("_fk"), F.struct(*[F.col(f"`{n}`") for n in foreign.columns]).alias("_fd")).where(F.col("_fk").isNotNull())
    local = df.select(mine[0].alias("_fk")).where(F.col("_fk").isNotNull()).distinct()
    rows = rows.join(local, "_fk", "left_semi").groupBy("_fk").agg(F.array_sort(F.collect_list("_fd")).alias("_fv"))
    joined = df.join(rows, mine[0] == F.col("_fk"), "left")
    return joined.select(*[F.col(f"`{n}`") for n in df.columns if n != spec["as"]], F.coalesce("_fv", none).alias(spec["as"]))


def out(df: DataFrame, name: str, ctx: Context) -> DataFrame:
    """Hand the rows to the sink under a name, or register a temporary view without one; they pass on."""
    seen = df.drop(*ctx.order)
    if ctx.sink is not None:
        ctx.sink(name, seen)
    else:
        seen.createOrReplaceTempView(name)
    return df


STAGES: dict[str, Callable] = {"$match": match, "$project": project, "$group": group, "$sort": sort, "$limit": limit, "$skip": skip, "$unwind": unwind, "$count": count, "$addFields": add_fields, "$replaceRoot": replace_root, "$lookup": lookup, "$out": out}


def aggregate(df: DataFrame, stages: list[dict], collections: dict[str, DataFrame] | None = None, sink=None, render_keys: bool = False) -> DataFrame:
    """Apply a pipeline. A stage object names one stage; an unknown one is an error."""
    ctx = Context(collections or {}, sink, [], render_keys)
    for i, stage in enumerate(stages):
        if not isinstance(stage, dict) or len(stage) != 1:
            raise QueryParseError("a stage is an object with one name")
        ((name, spec),) = stage.items()
        if name not in STAGES:
            raise QueryParseError(f"unknown stage {name}")
        # the next stage that makes new rows is the last to ask for the order of these
        ahead = next((s for s in stages[i + 1 :] if isinstance(s, dict) and ("$group" in s or "$count" in s)), {})
        ctx.wanted = _needs_order(ahead)
        df = STAGES[name](df, spec, ctx)
    return df.drop(*ctx.order)
