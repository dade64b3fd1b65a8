"""Bloom filter over a distributed column."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class BloomFilter:
    """m = -n ln p / ln(2)^2 bits and k = m / n ln 2 double hashes; no false negatives.

    Hashed and merged in the JVM.
    """

    def __init__(self, expected: int, rate: float = 0.01):
        self.m = max(8, math.ceil(-expected * math.log(rate) / math.log(2) ** 2))
        self.k = max(1, math.ceil(self.m / expected * math.log(2)))
        self.bits = np.zeros((self.m + 7) // 8, np.uint8)

    def _positions(self, c: Column) -> Column:
        h1, h2 = F.xxhash64(c, F.lit(1)), F.xxhash64(c, F.lit(2)).bitwiseOR(F.lit(1))
        return F.array(*[F.pmod(F.shiftright(h1, 1) + F.shiftright(h2, 8) * i, F.lit(self.m)) for i in range(self.k)])

    def build(self, df: DataFrame, col: str) -> BloomFilter:
        """Bits are set in bitmap aggregates of 32,768 each, merged map-side; the driver gets each once."""
        p = df.where(F.col(col).isNotNull()).select(F.explode(self._positions(F.col(col))).alias("p")).select((F.col("p") + 1).alias("p"))
        maps = p.groupBy(F.bitmap_bucket_number("p").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        for r in maps.toLocalIterator():
            at, part = (r["n"] - 1) * 4096, np.frombuffer(r["bits"], np.uint8)
            self.bits[at : at + 4096] |= part[: len(self.bits) - at]
        return self

    def might_contain(self, df: DataFrame, col: str, out: str = "maybe") -> DataFrame:
        """``df`` with a boolean ``out``; null values are never contained."""
        bits = df.sparkSession.sparkContext.broadcast(self.bits)

        @F.pandas_udf("boolean")
        def test(p: pd.Series) -> pd.Series:
            at = np.stack(p.to_numpy())
            return pd.Series((bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1))

        return df.withColumn(out, F.col(col).isNotNull() & test(self._positions(F.col(col))))
