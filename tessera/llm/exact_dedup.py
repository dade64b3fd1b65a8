"""Exact duplicates by progressive refinement: byte length, prefix hash, then full hash of the survivors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, written

PREFIX_CHARS = 64
_P = "_tsr_dup_"


def _text(text_col: str):
    return F.col(f"`{text_col}`")


def _prefix(text_col: str):
    return F.xxhash64(F.substring(_text(text_col), 1, PREFIX_CHARS))


def _among(df: DataFrame, keys: DataFrame, size: int, on: list[str], later: dict) -> DataFrame:
    """``df`` with the columns of ``later``, where another row shares the columns ``on``.

    If ``keys`` can be broadcast, only rows that pass have ``later`` worked out. Beyond that it is
    worked out for all rows and these are narrowed afterwards, so that no text is shuffled.
    """
    passed = small(keys, size)
    if passed is not keys:
        return df.join(passed, on, "left_semi").withColumns(later).drop(_P + "text")
    return df.withColumns(later).drop(_P + "text").join(keys, on, "left_semi")


def shared_lengths(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, int]:
    """(len, n) of the byte lengths of more than one text, and their size; written once."""
    t = _text(text_col)
    return written(docs.where(t.isNotNull()).groupBy(F.octet_length(t).alias("len")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lengths")


def shared_prefixes(docs: DataFrame, lengths: tuple[DataFrame, int], text_col: str = "text") -> tuple[DataFrame, int]:
    """(len, pre, n) of the length and prefix hash of more than one text among those of shared lengths; written once."""
    t = _text(text_col)
    rows = docs.where(t.isNotNull()).select(F.octet_length(t).alias("len"), t.alias(_P + "text"))
    rows = _among(rows, lengths[0].select("len"), lengths[1], ["len"], {"pre": _prefix(_P + "text")})
    return written(rows.groupBy("len", "pre").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "prefixes")


def full_hashes(docs: DataFrame, prefixes: tuple[DataFrame, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, full, x) of each row of a shared length and prefix: its text's SHA-256 and a short hash; written once."""
    t = _text(text_col)
    rows = docs.where(t.isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.octet_length(t).alias("len"), _prefix(text_col).alias("pre"), t.alias(_P + "text"))
    out = _among(rows, prefixes[0].select("len", "pre"), prefixes[1], ["len", "pre"], {"full": F.unhex(F.sha2(_text(_P + "text"), 256)), "x": F.xxhash64(_text(_P + "text"))})
    return written(out.select("id", "full", "x"), "full")[0]


def _refined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``full_hashes`` by way of lengths and prefixes; each stage looks only at what the one before left."""
    return full_hashes(docs, shared_prefixes(docs, shared_lengths(docs, text_col), text_col), id_col, text_col)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id): each document whose text equals that of ``keep_id``, the smallest id with it.

    Null texts equal nothing; empty texts equal each other; texts of any length are compared
    whole. Rows without an id can't be named and are left out; a repeated id with one text is
    one document. An empty table gives no rows; other columns are ignored. Groups of any size
    pass through partial aggregation and a join on the hash, never through one task's memory.
    """
    full = _refined(docs, id_col, text_col).where("id IS NOT NULL").select("id", "full").distinct()
    keep = full.groupBy("full").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return full.join(keep, "full").where("id <> keep_id").select(F.col("id").alias("doc_id"), "keep_id").distinct()


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text: that of the smallest id (ids before null).

    Rows with a null text all stay. Repeated rows of the kept id are cut to the first in order
    of all columns' hash. All columns are kept, whatever their names; an empty table stays empty.
    A row to drop is found again by its id and its text's 64-bit hash, in one anti-join; texts
    are not shuffled where the list of losers can be broadcast.
    """
    full = _refined(docs, id_col, text_col)
    n = full.groupBy("full").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    each = full.groupBy("full", "id", "x").agg(F.count(F.lit(1)).alias("same"))
    marked = each.join(n.drop("n"), "full").select(F.col("id").alias(_P + "id"), F.col("x").alias(_P + "x"), F.col("id").eqNullSafe(F.col("keep")).alias(_P + "again"), "same")
    losers, size = written(marked.where(f"NOT {_P}again OR same > 1").drop("same"), "losers")
    hit = F.col(f"`{id_col}`").eqNullSafe(F.col(_P + "id")) & (F.xxhash64(_text(text_col)) == F.col(_P + "x"))
    left = docs.join(small(losers, size), hit & _text(text_col).isNotNull(), "left_anti")
    twice = losers.where(_P + "again").drop(_P + "again")
    if twice.limit(1).count():
        cols = [F.col(f"`{c}`") for c in docs.columns]
        row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)])
        rows = docs.where(_text(text_col).isNotNull()).join(small(twice, size), hit).groupBy(_P + "id", _P + "x").agg(F.min_by(row, F.xxhash64(*cols)).alias("r"))
        left = left.unionByName(rows.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(docs.columns)]))
    return left


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = """
SELECT DISTINCT doc_id, keep_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL) WHERE doc_id <> keep_id
"""
