"""Text embeddings, hybrid ranking and rule-based inference."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryParseError
from .search import StoredTextIndex, TextIndex
from .vector_search import knn

DIMS = 384


@dataclass(frozen=True)
class ModelConfig:
    """How texts are embedded. Only the local model runs; it makes no remote call and reads texts whole."""

    provider: str = "local"
    model: str = "byte-chunks"
    dimensions: int = DIMS
    batch_size: int = 1024

    def __post_init__(self):
        if self.provider != "local":
            raise QueryParseError(f"no embedding provider {self.provider} here")
        if self.dimensions < 1 or self.batch_size < 1:
            raise QueryParseError("dimensions and batch_size are 1 or more")


#: What parses as a 64-bit float in text: signs, decimals, exponents, inf, infinity and nan.
NUMBER = r"^[+-]?(?i:inf|infinity|nan|\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?)$"


def extract_text(df: DataFrame, fields: list[str]) -> Column:
    """Strings and arrays of strings as they are, anything else as JSON, with spaces between."""
    parts = []
    for f in fields:
        dt = df.schema[f].dataType
        if isinstance(dt, T.StringType):
            parts.append(F.col(f))
        elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StringType):
            parts.append(F.concat_ws(" ", F.col(f)))
        else:
            parts.append(F.to_json(F.col(f)) if isinstance(dt, (T.StructType, T.ArrayType, T.MapType)) else F.col(f).cast("string"))
    return F.concat_ws(" ", *parts)


def embed_text(text: str, dims: int = DIMS) -> np.ndarray:
    """Sums of (byte - 128) / 256 over four-byte chunks dealt to the dimensions in turn, at unit length."""
    raw = np.frombuffer(text.encode(), np.uint8)
    v = np.bincount((np.arange(len(raw)) // 4) % dims, weights=(raw.astype(np.float64) - 128) / 256, minlength=dims)
    n = np.linalg.norm(v)
    return (v / n if n > 1e-6 else v).astype(np.float32)


def embed(df: DataFrame, id_col: str, text_col: str, dims: int = DIMS, config: ModelConfig | None = None) -> DataFrame:
    """(id, embedding); a null text gives a null embedding."""
    config = config or ModelConfig(dimensions=dims)
    dims, rows = config.dimensions, config.batch_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                s = b.slice(at, rows)
                vs = [None if t is None else embed_text(t, dims) for t in s.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(vs, pa.list_(pa.float32()))], names=[id_col, "embedding"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, embedding array<float>")


def vector_search(vectors: DataFrame, text: str, k: int, id_col: str, dims: int = DIMS) -> DataFrame:
    return knn(vectors, embed_text(text, dims), k, id_col=id_col)


def hybrid(nearest: DataFrame, keyword: DataFrame, limit: int, id_col: str, vector_weight: float = 0.7, keyword_weight: float = 0.3) -> DataFrame:
    """Weighted sum of vector and keyword scores over the vector candidates; without a keyword score, 0."""
    k = keyword.select(F.col("doc").alias(id_col), F.col("score").alias("keyword_score"))
    j = nearest.select(id_col, F.col("score").alias("vector_score")).join(k, id_col, "left").fillna(0.0, ["keyword_score"])
    total = F.col("vector_score") * vector_weight + F.col("keyword_score") * keyword_weight
    return j.withColumn("score", total).orderBy(F.desc("score"), id_col).limit(limit)


def hybrid_search(vectors: DataFrame, index: TextIndex | StoredTextIndex, query: str, query_vector, limit: int, id_col: str, candidates: int = 100) -> DataFrame:
    return hybrid(knn(vectors, query_vector, candidates, id_col=id_col), index.scored(index.terms_of(query)), limit, id_col)


def find_similar(vectors: DataFrame, doc_id, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest to a document's own vector, itself left out."""
    row = vectors.where(F.col(id_col) == doc_id).select(vec_col).first()
    if row is None:
        return knn(vectors, [0.0], 0, id_col=id_col, vec_col=vec_col)
    return knn(vectors.where(F.col(id_col) != doc_id), row[0], k, id_col=id_col, vec_col=vec_col)


def classify(text: Column, labels: list[str], threshold: float = 0.5) -> Column:
    """Array of (label, score): 0.85 where the text has the label in any case, else 0.15; those at the threshold or above."""
    all_ = F.array(*[F.struct(F.lit(x).alias("label"), F.when(F.lower(text).contains(x.lower()), 0.85).otherwise(0.15).alias("score")) for x in labels])
    return F.filter(all_, lambda r: r["score"] >= threshold)


def entities(text: Column) -> Column:
    """Array of (text, kind, score) of white-space tokens: EMAIL with ``@`` and ``.``, NUMBER by float syntax."""
    toks = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    as_email = F.transform(F.filter(toks, lambda w: w.contains("@") & w.contains(".")), lambda w: F.struct(w.alias("text"), F.lit("EMAIL").alias("kind"), F.lit(0.95).alias("score")))
    as_number = F.transform(F.filter(toks, lambda w: w.rlike(NUMBER)), lambda w: F.struct(w.alias("text"), F.lit("NUMBER").alias("kind"), F.lit(0.99).alias("score")))
    return F.concat(as_email, as_number)


def summarize(text: Column, most: int = 100) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def generate(prompt: Column, max_tokens: int = 100) -> Column:
    """The fixed text that stands for a generated one: the prompt's first 50 bytes, or as many as make whole characters, and the limit."""
    b = F.encode(prompt, "UTF-8")
    # 50 bytes at most: a byte is the first of a character unless its two upper bits are 10
    fits = [F.when((F.octet_length(prompt) <= n) | ~F.substring(F.hex(F.substring(b, n + 1, 1)), 1, 1).isin("8", "9", "A", "B"), F.decode(F.substring(b, 1, n), "UTF-8")) for n in (50, 49, 48, 47)]
    return F.concat(F.lit("[Generated text based on: '"), F.coalesce(*fits), F.lit(f"' (max {max_tokens} tokens)]"))


def answer(text: Column) -> Column:
    """Question answering and zero-shot labels have no model and give none."""
    return F.array().cast("array<string>")
