"""Mixing sources to target weights by Pareto order sampling.

A source h with weight w_h gets n_h = total * w_h / sum(w) copies (largest remainders make the
n_h whole). A document of size x expects m = n_h * x / X_h copies, X_h being its source's summed
sizes: floor(m) of them are certain, and the fraction p is the inclusion probability of one more.
Exactly k_h = n_h - sum(floor(m)) more are drawn, those of smallest u/(1-u) / (p/(1-p)), where u is
a uniform number hashed from the id. All counts are integers, so sizes are met exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, table, written

SEED = "mix-1"
#: Target weights by source; every other source, null included, has DEFAULT_WEIGHT.
WEIGHTS = {"src0": 6}
DEFAULT_WEIGHT = 1
_P = "_tsr_mix_"


def _size(n_chars):
    """Square root of the length, 1 at least; a null or negative length counts as 0 characters."""
    return F.floor(F.sqrt(F.greatest(F.coalesce(n_chars.cast("bigint"), F.lit(0)), F.lit(0)).cast("double"))).cast("bigint") + 1


def _weight(source, weights: dict, default: int):
    w = F.lit(default)
    for k, v in sorted(weights.items()):
        w = F.when(source == k, F.lit(int(v))).otherwise(w)
    return F.coalesce(w, F.lit(default)).cast("bigint")


def _uniform(key, seed: str):
    h = F.md5(F.concat(F.lit(seed + ":"), key).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """``df`` with its place from 1 on in ``order``, which has no ties, sorted over all tasks and not in one.

    Rows are dealt to ranges of the order; each range is numbered by itself, from the sum of the
    sizes of the ranges before it, of which there are as many as partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged, _ = written(df.repartitionByRange(parts, *order).withColumn(_P + "part", F.spark_partition_id()), "ranged")
    before = F.sum(_P + "many").over(Window.orderBy(_P + "part")) - F.col(_P + "many")
    counts = ranged.groupBy(_P + "part").agg(F.count(F.lit(1)).alias(_P + "many")).select(_P + "part", before.alias(_P + "before"))
    place = F.row_number().over(Window.partitionBy(_P + "part").orderBy(*order)) + F.col(_P + "before")
    return ranged.join(F.broadcast(counts), _P + "part").withColumn(out, place).drop(_P + "part", _P + "before")


def with_copies(docs: DataFrame, weights: dict | None = None, default_weight: int = DEFAULT_WEIGHT, total: int | None = None, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_chars", out: str = "copies") -> DataFrame:
    """``docs`` with a bigint column ``out``: how often each row occurs in the mixture, 0 included.

    ``total`` defaults to the number of rows. A null source is a source of its own, a null id
    hashes as '', ids of equal score are ordered as text; rows that tie in all of that are
    interchangeable and, when only some of them fit, are taken in order of their text's hash.
    An empty table gives no rows. A column already named ``out`` is replaced. What is shuffled
    has ids, sources and sizes only; one row a source is broadcast, if its size allows.
    """
    weights = WEIGHTS if weights is None else weights
    c = lambda n: F.col(_P + n)
    id_, source, size = (F.col(f"`{x}`") for x in (id_col, source_col, size_col))
    key = F.coalesce(id_.cast("string"), F.lit(""))
    narrow = docs.select(source.alias(_P + "s"), key.alias(_P + "key"), _size(size).alias(_P + "x"))

    per = narrow.groupBy(_P + "s").agg(F.count(F.lit(1)).alias(_P + "rows"), F.sum(_P + "x").alias(_P + "tot")).withColumn(_P + "w", _weight(c("s"), weights, default_weight))
    per, _ = written(per, "sources")
    n, w = per.agg(F.coalesce(F.sum(_P + "rows"), F.lit(0)), F.coalesce(F.sum(_P + "w"), F.lit(0))).first()
    rows, total = n, n if total is None else total
    wide = (F.lit(total).cast("decimal(20,0)") * c("w").cast("decimal(18,0)")).cast("decimal(38,0)")
    per = per.withColumn(_P + "n", F.expr(f"{total} * CAST({_P}w AS DECIMAL(18,0)) DIV {max(w, 1)}").cast("bigint")).withColumn(_P + "rem", (wide % F.lit(max(w, 1))).cast("bigint"))
    left = total - (per.agg(F.coalesce(F.sum(_P + "n"), F.lit(0))).first()[0]) if n else 0
    per = _numbered(per, [c("rem").desc(), c("s").asc_nulls_first()], _P + "place")
    per = per.select(_P + "s", (c("n") + (c("place") <= left).cast("bigint")).alias(_P + "n"), _P + "tot")
    per, per_size = written(per, "allocation")

    def scored(df, stats, stats_size):
        right = stats.withColumnRenamed(_P + "s", _P + "s2")
        df = df.join(small(right, stats_size), c("s").eqNullSafe(c("s2")), "left").drop(_P + "s2")
        m = c("n") * c("x")
        df = df.withColumn(_P + "whole", F.expr(f"{_P}n * {_P}x DIV {_P}tot")).withColumn(_P + "r", m % c("tot"))
        u = _uniform(c("key"), seed)
        q = F.when(c("r") > 0, (u * (c("tot") - c("r")).cast("double")) / ((F.lit(1.0) - u) * c("r").cast("double")))
        return df.withColumn(_P + "q", q)

    # The k-th smallest score of each source: counts by score bucket, then a rank inside one bucket.
    buckets = 1 << max(10, math.ceil(math.log2(max(rows, 1) / 4096)) if rows > 4096 else 10)
    bucket = F.floor(c("q") / (F.lit(1.0) + c("q")) * F.lit(float(buckets))).cast("bigint")
    s = scored(narrow, per, per_size).withColumn(_P + "b", bucket)
    hist = s.groupBy(_P + "s", _P + "b").agg(F.count(F.lit(1)).alias(_P + "c"), F.sum(_P + "whole").alias(_P + "wholes"), F.first(_P + "n").alias(_P + "n"))
    by = Window.partitionBy(_P + "s")
    hist = (
        hist.withColumn(_P + "k", F.max(_P + "n").over(by) - F.sum(_P + "wholes").over(by))
        .withColumn(_P + "cum", F.sum(F.when(c("b").isNotNull(), c("c")).otherwise(0)).over(by.orderBy(c("b").asc_nulls_first())))
        .where(c("b").isNotNull() & (c("cum") >= c("k")) & (c("cum") - c("c") < c("k")))
        .select(_P + "s", c("b").alias(_P + "cb"), (c("k") - c("cum") + c("c")).alias(_P + "need"))
    )
    edge, edge_size = written(hist, "boundary")
    right = edge.withColumnRenamed(_P + "s", _P + "s2")
    inside = s.join(small(right, edge_size), c("s").eqNullSafe(c("s2")) & (c("b") == c("cb"))).select(_P + "s", _P + "q", _P + "key", _P + "need")
    inside = inside.groupBy(_P + "s", _P + "q", _P + "key", _P + "need").agg(F.count(F.lit(1)).alias(_P + "same"))
    upto = F.sum(_P + "same").over(Window.partitionBy(_P + "s").orderBy(_P + "q", _P + "key"))
    cut = inside.withColumn(_P + "upto", upto).where((c("upto") >= c("need")) & (c("upto") - c("same") < c("need")))
    cut = cut.select(_P + "s", c("q").alias(_P + "cq"), c("key").alias(_P + "ckey"), (c("need") - c("upto") + c("same")).alias(_P + "take"), (c("upto") > c("need")).alias(_P + "partial"))
    r2 = cut.withColumnRenamed(_P + "s", _P + "s2")
    stats = per.join(r2, c("s").eqNullSafe(c("s2")), "left").drop(_P + "s2")
    stats, stats_size = written(stats, "cuts")

    df = docs.drop(out).withColumns({_P + "s": source, _P + "key": key, _P + "x": _size(size)})
    df = scored(df, stats, stats_size)
    at = c("q").eqNullSafe(c("cq")) & (c("key") == c("ckey")) & c("cq").isNotNull()
    extra = F.coalesce((c("q") < c("cq")) | ((c("q") == c("cq")) & (c("key") <= c("ckey"))), F.lit(False))
    if stats.where(c("partial")).limit(1).count():
        # Repeated ids on a cut: rank those rows only.
        df = df.withColumn(_P + "tie", at & F.coalesce(c("partial"), F.lit(False)))
        rank = F.row_number().over(Window.partitionBy(_P + "s").orderBy(F.xxhash64(*[F.col(f"`{x}`") for x in docs.columns if x != out])))
        tied = df.where(_P + "tie").withColumn(_P + "rank", rank)
        df = df.where(~c("tie")).withColumn(_P + "rank", F.lit(0)).unionByName(tied)
        extra = extra & (c("rank") <= F.coalesce(c("take"), F.lit(0)))
    kept = [x for x in docs.columns if x != out]
    return df.select(*[F.col(f"`{x}`") for x in kept], (c("whole") + extra.cast("bigint")).alias(out))


def mixture(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs``, each as often as ``with_copies`` says, with the columns of ``docs``."""
    n = _P + "copies"
    df = with_copies(docs, out=n, **kw).where(F.col(n) > 0)
    return df.select(*[F.col(f"`{x}`") for x in docs.columns], F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n))).alias(_P + "i")).drop(_P + "i")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return with_copies(docs).where("copies > 0").select("doc_id", "source", "copies")


OP2_CTES = """
mx AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS mkey, CAST(floor(sqrt(CAST(greatest(coalesce(n_chars, 0), 0) AS DOUBLE))) AS BIGINT) + 1 AS x, CASE WHEN source = 'src0' THEN 6 ELSE 1 END AS w FROM {docs}),
mh AS (SELECT source, count(*) AS c, sum(x) AS bx, any_value(w) AS w FROM mx GROUP BY source),
mt AS (SELECT sum(c) AS t, sum(w) AS sw FROM mh),
ma AS (SELECT source, bx, t * w // sw AS n0, row_number() OVER (ORDER BY t * w % sw DESC, source ASC NULLS FIRST) AS rn, t FROM mh, mt),
mn AS (SELECT source AS s, bx, n0 + CASE WHEN rn <= t - (SELECT sum(n0) FROM ma) THEN 1 ELSE 0 END AS n FROM ma),
ms AS (SELECT mx.*, n * x // bx AS whole, n * x % bx AS r, n, bx, (CAST(CAST('0x' || substr(md5('mix-1:' || mkey), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM mx JOIN mn ON mx.source IS NOT DISTINCT FROM mn.s),
mq AS (SELECT *, CASE WHEN r > 0 THEN (u * CAST(bx - r AS DOUBLE)) / ((1.0 - u) * CAST(r AS DOUBLE)) END AS q FROM ms),
mr AS (SELECT *, row_number() OVER (PARTITION BY source, r > 0 ORDER BY q, mkey) AS qrank, n - sum(whole) OVER (PARTITION BY source) AS k FROM mq),
mixed AS (SELECT *, CAST(whole + CASE WHEN r > 0 AND qrank <= k THEN 1 ELSE 0 END AS BIGINT) AS copies FROM mr)
"""
OP2_SQL = "WITH " + OP2_CTES.format(docs="documents") + "SELECT doc_id, source, copies FROM mixed WHERE copies > 0"
