"""Schema validation as one Column of error messages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..plans.filters import safe_pattern


@dataclass
class Field:
    type: str = "any"
    required: bool = False
    default: object = None
    min: float | None = None
    max: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    allowed_values: list | None = None
    nested: Schema | None = None


@dataclass
class Schema:
    fields: dict[str, Field] = field(default_factory=dict)
    allow_additional_fields: bool = True


def _checks(schema: Schema, names: dict[str, tuple[Column, T.DataType]], prefix: str = "") -> list[Column]:
    out = []
    for name, f in schema.fields.items():
        path, at = prefix + name, names.get(name)
        if at is None:
            if f.required and f.default is None:
                out.append(F.lit(f"{path} is required"))
            continue
        c, dt = at
        if f.required and f.default is None:
            out.append(F.when(c.isNull(), F.lit(f"{path} is required")))
        typed = F.lit(True) if f.type == "any" else F.coalesce(V.type_name(c, dt) == f.type, F.lit(False))
        if f.type != "any":
            out.append(F.when(c.isNotNull() & ~typed, F.lit(f"{path} must be {f.type}")))
        rules, tag = [], V.column_tag(dt)
        if tag in V.NUMERIC:
            rules += [(c < f.min, f"{path} is below {f.min}")] if f.min is not None else []
            rules += [(c > f.max, f"{path} is above {f.max}")] if f.max is not None else []
        if tag in ("string", "array"):
            n = F.octet_length(c) if tag == "string" else F.size(c)
            rules += [(n < f.min_length, f"{path} is shorter than {f.min_length}")] if f.min_length is not None else []
            rules += [(n > f.max_length, f"{path} is longer than {f.max_length}")] if f.max_length is not None else []
        if tag == "string" and f.pattern is not None and safe_pattern(f.pattern):
            rules.append((~c.rlike(f.pattern), f"{path} doesn't match {f.pattern}"))
        if f.allowed_values is not None:
            ok = F.lit(False)
            for v in f.allowed_values:
                ok = ok | F.coalesce(V.equals(c, dt, v), F.lit(False))
            rules.append((~ok, f"{path} isn't an allowed value"))
        out += [F.when(c.isNotNull() & typed & bad, F.lit(text)) for bad, text in rules]
        if f.nested is not None and isinstance(dt, T.StructType):
            inner = {n: (c.getField(n), dt[n].dataType) for n in dt.names}
            out += [F.when(c.isNotNull(), e) for e in _checks(f.nested, inner, path + ".")]
    if not schema.allow_additional_fields:
        for name, (c, _) in names.items():
            if name not in schema.fields:
                out.append(F.when(c.isNotNull(), F.lit(f"{prefix}{name} isn't in the schema")))
    return out


def errors(df: DataFrame, schema: Schema) -> Column:
    """All messages of a row joined by ``; ``, or null where it is valid."""
    checks = _checks(schema, {n: (F.col(f"`{n}`"), df.schema[n].dataType) for n in df.columns})
    text = F.concat_ws("; ", *checks) if checks else F.lit("")
    return F.when(text != "", text)


def validate(df: DataFrame, schema: Schema) -> DataFrame:
    return df.withColumn("_errors", errors(df, schema))
