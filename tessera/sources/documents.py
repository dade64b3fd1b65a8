"""JSON sources and sinks of documents, typed or as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of a known schema; inference would cost a pass over the input."""
    return spark.read.schema(schema).json(path)


def parse(c: Column, schema: str) -> Column:
    return F.from_json(c, schema)


def to_json(df: DataFrame, out: str = "json") -> DataFrame:
    """Each row as one JSON text; missing fields are left out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{n}`") for n in df.columns])).alias(out))


def dynamic(c: Column) -> Column:
    """A JSON text as VARIANT: values keep their own types, and null differs from missing. Null for anything but an object."""
    v = F.try_parse_json(c)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


TAGS = {"BOOLEAN": "boolean", "STRING": "string", "DOUBLE": "double", "FLOAT": "double", "VOID": "null", "BINARY": "binary", "TIMESTAMP": "datetime", "DATE": "datetime"}


def tag(v: Column, path: str) -> Column:
    """Type tag at a path of a VARIANT, null where the path is missing."""
    x = F.variant_get(v, f"$.{path}", "variant")
    s = F.schema_of_variant(x)
    n = F.try_variant_get(v, f"$.{path}", "bigint")
    out = F.when(s == "BIGINT", F.when(n.between(-(1 << 31), (1 << 31) - 1), "int32").otherwise("int64"))
    out = out.when(s.startswith("DECIMAL"), "double").when(s.startswith("OBJECT"), "document").when(s.startswith("ARRAY"), "array")
    for k, t in TAGS.items():
        out = out.when(s == k, t)
    return F.when(x.isNotNull(), out)


def variant_equals(v: Column, path: str, value) -> Column:
    """Strict equality at a path of a VARIANT: the tags are equal, then the values."""
    from ..functions.values import literal_tag

    t = literal_tag(value)
    kind = {"int32": "bigint", "int64": "bigint", "double": "double", "string": "string", "boolean": "boolean"}.get(t)
    same = tag(v, path) == t
    if kind is not None:
        same = same & (F.try_variant_get(v, f"$.{path}", kind) == F.lit(value))
    return F.coalesce(same, F.lit(False))


def variant_exists(v: Column, path: str) -> Column:
    return F.variant_get(v, f"$.{path}", "variant").isNotNull()
