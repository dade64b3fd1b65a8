"""Type tags, paths and scalar functions of the document model, as Columns."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT32 = range(-(1 << 31), 1 << 31)
INT64 = range(-(1 << 63), 1 << 63)
NUMERIC = ("int32", "int64", "int", "double")
ORDERED = ("boolean", "string", "datetime")


def column_tag(dt: T.DataType) -> str:
    """Tag of a column's values; ``int`` for bigint, whose values are int32 or int64 one by one."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType)):
        return "int32"
    if isinstance(dt, T.LongType):
        return "int"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(dt, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dt, T.BinaryType):
        return "binary"
    if isinstance(dt, T.ArrayType):
        return "array"
    if isinstance(dt, (T.StructType, T.MapType)):
        return "document"
    return "null"


def literal_tag(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "int32" if v in INT32 else "int64" if v in INT64 else "double"
    if isinstance(v, float):
        return "double"
    if isinstance(v, str):
        return "string"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return "datetime"
    if isinstance(v, (bytes, bytearray)):
        return "binary"
    if isinstance(v, (list, tuple)):
        return "array"
    return "document"


def resolve(schema: T.StructType, path: str, root=F.col) -> tuple[Column, T.DataType] | None:
    """Column and type at a dotted path; numbers index arrays. None where no document can have it."""
    if path in schema.names:
        return root(f"`{path}`"), schema[path].dataType
    head, *rest = path.split(".")
    if head not in schema.names:
        return None
    c, dt = root(f"`{head}`"), schema[head].dataType
    for seg in rest:
        if isinstance(dt, T.StructType) and seg in dt.names:
            c, dt = c.getField(seg), dt[seg].dataType
        elif isinstance(dt, T.MapType):
            c, dt = F.try_element_at(c, F.lit(seg)), dt.valueType
        elif isinstance(dt, T.ArrayType) and seg.isdigit():
            c, dt = F.try_element_at(c, F.lit(int(seg) + 1)), dt.elementType
        else:
            return None
    return c, dt


def equals(c: Column, dt: T.DataType, v, coerce: bool = False) -> Column:
    """Equality by tag and value: 5 is not 5.0. Null where the column is null."""
    tag, lit_tag = column_tag(dt), literal_tag(v)
    if lit_tag == "null":
        return F.lit(False)
    if tag == "array" and lit_tag == "array":
        parts = [F.size(c) == len(v), *(equals(F.try_element_at(c, F.lit(i + 1)), dt.elementType, x, coerce) for i, x in enumerate(v))]
        return _all(parts)
    if tag == "document" and lit_tag == "document":
        if not isinstance(dt, T.StructType) or not set(v) <= set(dt.names):
            return F.lit(False)
        parts = [F.coalesce(equals(c.getField(n), dt[n].dataType, v[n], coerce), F.lit(False)) if v.get(n) is not None else c.getField(n).isNull() for n in dt.names]
        return c.isNotNull() & _all(parts)
    same = tag == lit_tag or (tag == "int" and lit_tag in ("int32", "int64")) or (coerce and tag in NUMERIC and lit_tag in NUMERIC)
    return c == F.lit(v) if same else F.lit(False)


def compares(op: str, c: Column, dt: T.DataType, v) -> Column:
    """Order comparison: across numbers, else within one ordered tag; false for any other pair."""
    tag, lit_tag = column_tag(dt), literal_tag(v)
    if not ((tag in NUMERIC and lit_tag in NUMERIC) or (tag == lit_tag and tag in ORDERED)):
        return F.lit(False)
    v = F.lit(v)
    return {"$gt": c > v, "$gte": c >= v, "$lt": c < v, "$lte": c <= v}[op]


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def as_text(c: Column, dt: T.DataType) -> Column:
    return c if column_tag(dt) == "string" else F.lit(None).cast("string")


def set_path(c: Column, path: str, value) -> Column:
    """A document column with a dotted path set; missing documents on the way are made."""
    head, *rest = path.split(".")
    if not rest:
        return c.withField(head, F.lit(value))
    inner = c.getField(head)
    return c.withField(head, set_path(inner, ".".join(rest), value))


def type_name(c: Column, dt: T.DataType) -> Column:
    """Tag of each value; null for a missing one."""
    tag = column_tag(dt)
    if tag == "int":
        return F.when(c.between(INT32.start, INT32.stop - 1), "int32").when(c.isNotNull(), "int64")
    return F.when(c.isNotNull(), tag)


def is_truthy(c: Column, dt: T.DataType) -> Column:
    """False for missing, false, zero and empty values."""
    tag = column_tag(dt)
    if tag == "boolean":
        t = c
    elif tag in NUMERIC:
        t = c != 0
    elif tag == "string":
        t = c != ""
    elif tag == "array" or isinstance(dt, T.MapType):
        t = F.size(c) > 0
    elif tag == "document":
        t = F.lit(bool(dt.names)) & c.isNotNull()
    else:
        t = c.isNotNull()
    return F.coalesce(t, F.lit(False))


def as_number(c: Column, dt: T.DataType) -> Column:
    return c.cast("double") if column_tag(dt) in NUMERIC else F.lit(None).cast("double")


def display(c: Column, dt: T.DataType) -> Column:
    """Text of a value as group keys render it: strings quoted, arrays and documents in outline, whole doubles without a fraction."""
    tag = column_tag(dt)
    if tag == "string":
        return F.concat(F.lit('"'), c, F.lit('"'))
    if tag == "double":
        c = c.cast("double")
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    if tag == "array":
        return F.when(c.isNotNull(), F.concat(F.lit("["), F.size(c).cast("string"), F.lit(" elements]")))
    if tag == "document":
        return F.when(c.isNotNull(), F.lit("{...}"))
    return c.cast("string")


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def hex_encode(c: Column) -> Column:
    return F.lower(F.hex(c))


def format_bytes(c: Column) -> Column:
    """Two decimals in the largest unit of 1024 steps that keeps the number at 1 or above; plain bytes below."""
    out = F.concat(c.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(c >= 1024**i, F.concat(F.format_string("%.2f", c.cast("double") / float(1024**i)), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_duration_us(c: Column) -> Column:
    d = c.cast("double")
    return (
        F.when(c >= 1_000_000, F.concat(F.format_string("%.2f", d / 1e6), F.lit("s")))
        .when(c >= 1000, F.concat(F.format_string("%.2f", d / 1e3), F.lit("ms")))
        .otherwise(F.concat(c.cast("string"), F.lit("µs")))
    )


def is_valid_name(c: Column) -> Column:
    """1 to 128 bytes of letters, digits, ``_`` and ``-``."""
    return F.coalesce(c.rlike(r"^[\p{IsAlphabetic}\p{N}_-]+$") & (F.octet_length(c) <= 128), F.lit(False))


def generate_id() -> Column:
    return F.uuid()


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp())


def crc32(c: Column) -> Column:
    return F.crc32(c.cast("binary"))


def from_extended(v):
    """A Python value from extended JSON: wrappers of one key become what they stand for."""
    import base64

    if isinstance(v, list):
        return [from_extended(x) for x in v]
    if not isinstance(v, dict):
        return v
    if len(v) == 1:
        ((k, x),) = v.items()
        if k == "$date" and isinstance(x, str):
            return datetime.datetime.fromisoformat(x) if "T" in x else datetime.date.fromisoformat(x)
        if k == "$binary" and isinstance(x, str):
            return base64.b64decode(x)
        if k == "$oid" and isinstance(x, str):
            return x
    return {k: from_extended(x) for k, x in v.items()}


def to_extended(v):
    """A Python value as extended JSON: ``$oid``-like wrappers for what JSON lacks."""
    import base64

    if isinstance(v, (datetime.datetime, datetime.date)):
        return {"$date": v.isoformat()}
    if isinstance(v, (bytes, bytearray)):
        return {"$binary": base64.b64encode(bytes(v)).decode()}
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if isinstance(v, dict):
        return {k: to_extended(v[k]) for k in sorted(v)}
    if isinstance(v, (list, tuple)):
        return [to_extended(x) for x in v]
    if hasattr(v, "asDict"):
        return to_extended(v.asDict())
    return v
