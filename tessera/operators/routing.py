"""Consistent-hash routing and key ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ring(spark: SparkSession, shards: list[str], virtual: int = 16) -> DataFrame:
    """(h, shard): positions of ``id:i`` for each virtual node, 16 hex digits of SHA-256 that compare as text."""
    rows = spark.createDataFrame([(s, i) for s in shards for i in range(virtual)], "shard string, i int")
    return rows.select(position(F.concat_ws(":", "shard", "i")).alias("h"), "shard")


def position(key: Column) -> Column:
    return F.substring(F.sha2(key.cast("binary"), 256), 1, 16)


def route(df: DataFrame, key: Column, ring_df: DataFrame) -> DataFrame:
    """``df`` with ``shard``: the first node at the key's position or after, around the ring.

    The ring is shards times virtual nodes, collected as one sorted literal array, so routing
    is a scan in the JVM without a join. A key is hashed once, in a projection of its own, and
    its place found by halving the sorted ring: one comparison for each doubling of the nodes.
    """
    nodes = sorted((r["h"], r["shard"]) for r in ring_df.collect())
    places = F.array(*[F.lit(h) for h, _ in nodes])
    shards = F.array(*[F.lit(s) for _, s in nodes], F.lit(nodes[0][1]))
    # lo counts nodes before the position; a null key has none and stays null
    steps, lo, h = [1 << b for b in reversed(range(len(nodes).bit_length()))], F.lit(0), F.col("_tsr_at")
    found = F.aggregate(F.array(*map(F.lit, steps)), lo, lambda n, s: F.when((n + s <= len(nodes)) & (F.element_at(places, F.least(n + s, F.lit(len(nodes)))) < h), n + s).otherwise(n))
    out = df.withColumn("_tsr_at", position(key))
    return out.withColumn("shard", F.when(h.isNotNull(), F.element_at(shards, found + 1))).drop("_tsr_at")


def in_range(c: Column, low, high) -> Column:
    """Half-open key range."""
    return (c >= low) & (c < high)


def unique_violations(df: DataFrame, keys: list[str], sparse: bool = False, out: str = "n") -> DataFrame:
    """Keys of more than one document; with ``sparse``, documents without any key field don't count."""
    if sparse:
        some = F.lit(False)
        for k in keys:
            some = some | F.col(k).isNotNull()
        df = df.where(some)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)).where(F.col(out) > 1)
