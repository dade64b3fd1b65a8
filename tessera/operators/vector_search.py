"""Nearest neighbours: exact, inverted-file approximate, and product quantization."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DuplicateKeyError, NotFoundError
from ..functions.vectors import METRICS
from ..sources import scratch


def _literal(vector) -> F.Column:
    return F.array(*[F.lit(float(x)).cast("float") for x in vector])


def knn(df: DataFrame, query, k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", filter_query=None) -> DataFrame:
    """(id, distance, score) of the k nearest to one vector; score is 1 - distance. Top-k is taken in every partition first."""
    d = df.where(filter_query) if filter_query is not None else df
    dist = METRICS[metric](F.col(vec_col), _literal(query))
    return d.where(usable(vec_col, len(query))).select(F.col(id_col), dist.alias("distance")).orderBy("distance", id_col).limit(k).withColumn("score", F.lit(1.0) - F.col("distance"))


def knn_threshold(df: DataFrame, query, k: int, least: float, **kw) -> DataFrame:
    """The k nearest, then those of them whose score reaches ``least``."""
    return knn(df, query, k, **kw).where(F.col("score") >= least)


def usable(vec_col: str, dims: int | None = None):
    """Whether a row has a vector, of the given length and of numbers only; others are in no result and no model."""
    v = F.col(vec_col)
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    return ok & (F.size(v) == dims) if dims is not None else ok


def dimensions(df: DataFrame, vec_col: str) -> int:
    """The length that most vectors have, the least of several; 0 without any."""
    row = df.where(usable(vec_col)).groupBy(F.size(vec_col).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return 0 if row is None else row["d"]


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return 1 - a @ b.T / np.maximum(np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None], 1e-10)
    if metric == "dot":
        return -(a @ b.T)
    if metric == "euclidean":
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))
    return np.stack([np.abs(x[None] - b).sum(1) for x in a])


def _pair_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of ``a`` to the same row of ``b``; equal vectors are at equal distances wherever they stand, as by ``_distances`` they needn't be."""
    if metric == "euclidean":
        return np.sqrt(((a - b) ** 2).sum(1))
    if metric == "manhattan":
        return np.abs(a - b).sum(1)
    dot = np.einsum("ij,ij->i", a, b)
    return -dot if metric == "dot" else 1 - dot / np.maximum(np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b)), 1e-10)


#: Rows of one side of a block whose distances are worked out at once.
BLOCK_ROWS = 2048
#: Bytes of vectors of one side of a block that a task gets.
BLOCK_BYTES = 16 << 20


def _rows_a_block(dims: int) -> int:
    return max(BLOCK_ROWS, BLOCK_BYTES // (4 * max(1, dims)))


def _block_nearest(k: int, metric: str, id_col: str, vec_col: str):
    """(query_id, id, distance) of the k nearest of a block of rows to each of a block of queries, ties by id, itself left out.

    Blocks are compared by BLOCK_ROWS rows. A matrix product finds what may be nearer than the
    best k so far, within its rounding; of these the distance is worked out by itself.
    """

    def nearest(a: np.ndarray, own: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, col, dist, kth = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.full(len(a), np.inf)
        scale = {"cosine": 1.0, "dot": np.linalg.norm(a, axis=1).max() * np.linalg.norm(b, axis=1).max()}.get(metric, np.linalg.norm(a, axis=1).max() + np.linalg.norm(b, axis=1).max())
        norms = [np.linalg.norm(x, axis=1) for x in (a, b)]
        # in single precision, whose rounding of a sum of n products of unit vectors is below ``slack``; not where the distance has the least divisor
        slack = 2.4e-7 * (a.shape[1] + 8)
        single = metric == "cosine" and a.shape[1] <= 4096 and all(np.isfinite(x).all() and x[x > 0].min(initial=1.0) >= 1e-4 for x in norms)
        unit = [(x / np.where(l > 0, l, 1.0)[:, None]).astype(np.float32) for x, l in zip((a, b), norms)] if single else []
        for at in range(0, len(b), BLOCK_ROWS):
            part = b[at : at + BLOCK_ROWS]
            if single and np.isfinite(kth).all():
                # most rows of later blocks are farther, and fall by one comparison
                like = unit[0] @ unit[1][at : at + BLOCK_ROWS].T
                found = np.flatnonzero(like >= (1 - kth - slack).astype(np.float32)[:, None])
                r, c = found // like.shape[1], found % like.shape[1]
                other = own[r] != ids[at + c]
                r, c = r[other], c[other]
            else:
                d = _distances(a, part, metric)
                d[own[:, None] == ids[None, at : at + BLOCK_ROWS]] = np.inf
                n = min(k, d.shape[1])
                least = kth if np.isfinite(kth).all() else np.minimum(kth, np.partition(d, n - 1, axis=1)[:, n - 1])
                r, c = np.nonzero((d <= (least + 1e-6 * (np.abs(least) + scale))[:, None]) & (d < np.inf))
            for i in range(0, len(r), 1 << 18):
                p, q = r[i : i + (1 << 18)], c[i : i + (1 << 18)]
                row, col, dist = np.append(row, p), np.append(col, q + at), np.append(dist, _pair_distances(a[p], part[q], metric))
                order = np.lexsort((col, dist, row))  # columns come in order of their ids
                row, col, dist = row[order], col[order], dist[order]
                ok = np.arange(len(row)) - np.searchsorted(row, np.arange(len(a)))[row] < k
                row, col, dist = row[ok], col[ok], dist[ok]
            last = np.nonzero(np.arange(len(row)) - np.searchsorted(row, np.arange(len(a)))[row] == k - 1)[0]
            kth[row[last]] = dist[last]
        return row, col, dist

    def score(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t) or k < 1:
            return pd.DataFrame({"query_id": [], id_col: [], "distance": []})
        t = t.sort_values(id_col)
        b, ids = np.stack(t[vec_col].to_numpy()).astype(np.float64), t[id_col].to_numpy()
        out = []
        for at in range(0, len(q), BLOCK_ROWS):
            own = q[id_col].to_numpy()[at : at + BLOCK_ROWS]
            row, col, dist = nearest(np.stack(q[vec_col].to_numpy()[at : at + BLOCK_ROWS]).astype(np.float64), own, b, ids)
            out.append(pd.DataFrame({"query_id": own[row], id_col: ids[col], "distance": dist}))
        return pd.concat(out, ignore_index=True)

    return score


def _best(near: DataFrame, k: int, id_col: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_col))
    return near.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def knn_join(queries: DataFrame, df: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, distance) of each query's k nearest, itself left out and ties by id, in Arrow blocks.

    Both sides are cut into blocks by a hash of their ids, and each pair of blocks yields k
    candidates a query. There are a few pairs a core, however many rows there are, until a block
    holds ``BLOCK_BYTES`` of vectors: up to there what is shuffled grows with the rows, and what a
    task holds is bounded. Exact, so the work is queries times rows; ``StoredIvf.join`` reads the nearest cells only. Rows without a usable
    vector of the usual length are left out.
    """
    dims = dimensions(df, vec_col)
    q, t = queries.where(usable(vec_col, dims)), df.where(usable(vec_col, dims))
    rows = [x.count() for x in (q, t)]
    a_core = math.isqrt(rows[0] * rows[1] // (4 * df.sparkSession.sparkContext.defaultParallelism)) + 1
    n_q, n_t = (max(1, -(-n // min(max(a_core, BLOCK_ROWS), _rows_a_block(dims)))) for n in rows)
    cut = lambda d, name, n: d.select(F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias(name), F.col(id_col), F.col(vec_col))
    left = cut(q, "qb", n_q).withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(n_t - 1))))
    right = cut(t, "tb", n_t).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    near = left.groupBy("qb", "tb").cogroup(right.groupBy("qb", "tb")).applyInPandas(_block_nearest(k, metric, id_col, vec_col), f"query_id bigint, {id_col} bigint, distance double")
    return _best(near, k, id_col)


#: Vectors that centroids and codebooks are fitted on, chosen by the hash of their ids; every vector is indexed.
SAMPLE = 20_000


def _sample(df: DataFrame, id_col: str, vec_col: str, most: int) -> np.ndarray:
    """At most ``most`` usable vectors, those of the least hashes of their ids."""
    dims = dimensions(df, vec_col)
    few = df.where(usable(vec_col, dims)).select(vec_col).orderBy(F.xxhash64(id_col), id_col).limit(most).collect()
    return np.array([r[0] for r in few], np.float64).reshape(len(few), dims)


class IvfIndex:
    """Inverted file: vectors by nearest of ``cells`` centroids; a query reads the nearest cells only.

    How many it reads is the least that found ``recall`` of the ten nearest of queries drawn
    from the sample that the centroids are fitted on, each query itself left out. ``sample``
    bounds that sample; all usable vectors are assigned, and the others are in no cell.
    """

    def __init__(self, df: DataFrame, cells: int = 16, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 1, sample: int = SAMPLE, recall: float = 0.95):
        self.id_col, self.vec_col = id_col, vec_col
        x = _sample(df, id_col, vec_col, sample)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
        self.centroids = kmeans(x, min(cells, len(x)), seed=seed) if len(x) else np.zeros((1, max(1, x.shape[1])))
        self.probes = self._calibrated(x, recall) if len(x) > 1 else 1
        self.assigned = df.where(usable(vec_col, x.shape[1])).withColumn("cell", _nearest(self.centroids, vec_col))

    def _calibrated(self, x: np.ndarray, recall: float, queries: int = 200, k: int = 10) -> int:
        q = x[:queries]
        order = np.argsort((self.centroids**2).sum(1)[None] - 2 * q @ self.centroids.T, axis=1)
        cell = np.argmin((self.centroids**2).sum(1)[None] - 2 * x @ self.centroids.T, axis=1)
        like = q @ x.T
        like[np.arange(len(q)), np.arange(len(q))] = -np.inf
        near = np.argsort(-like, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
        rank = np.argsort(order, axis=1)[np.arange(len(q))[:, None], cell[near]]
        return next(p for p in range(1, len(self.centroids) + 1) if (rank < p).mean() >= recall)

    def _cells(self, query, probes: int | None) -> list[int]:
        q = np.array(query, np.float64)
        q /= max(np.linalg.norm(q), 1e-10)
        return [int(c) for c in np.argsort(((self.centroids - q) ** 2).sum(1), kind="stable")[: probes or self.probes]]

    def search(self, query, k: int, probes: int | None = None) -> DataFrame:
        return knn(self.assigned.where(F.col("cell").isin(self._cells(query, probes))), query, k, id_col=self.id_col, vec_col=self.vec_col)

    def join(self, queries: DataFrame, k: int, probes: int | None = None, metric: str = "cosine") -> DataFrame:
        """(query_id, id, distance) of each query's k nearest in its nearest cells, by blocks of a cell's rows and of its queries.

        A cell of any size is cut into blocks of about BLOCK_BYTES of vectors, and so are its queries.
        """
        dims = self.centroids.shape[1]
        rows = self.assigned.select("cell", F.col(self.id_col), F.col(self.vec_col))
        asked = queries.where(usable(self.vec_col, dims)).select(F.explode(_nearest_cells(self.centroids, self.vec_col, probes or self.probes)).alias("cell"), F.col(self.id_col), F.col(self.vec_col))
        cut = lambda d, name: F.broadcast(d.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(_rows_a_block(dims))).cast("int").alias(name)))
        blocks = F.broadcast(cut(rows, "n_t").join(cut(asked, "n_q"), "cell"))  # a row a cell
        mine = lambda n: F.pmod(F.xxhash64(self.id_col, F.lit(7)), F.col(n)).cast("int")
        left = asked.join(blocks, "cell").withColumns({"qb": mine("n_q")}).withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("n_t") - 1)))
        right = rows.join(blocks, "cell").withColumns({"tb": mine("n_t")}).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)))
        cols = ["cell", "qb", "tb", self.id_col, self.vec_col]
        by = ["cell", "qb", "tb"]
        near = left.select(cols).groupBy(by).cogroup(right.select(cols).groupBy(by)).applyInPandas(_block_nearest(k, metric, self.id_col, self.vec_col), f"query_id bigint, {self.id_col} bigint, distance double")
        return _best(near, k, self.id_col)


class StoredIvf(IvfIndex):
    """An inverted file on disk, in a folder a cell: a query prunes to the folders of its cells, and nothing is assigned again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.meta = spark, path, scratch.load(spark, f"{path}/meta.json")
        self.id_col, self.vec_col = self.meta["id_col"], self.meta["vec_col"]
        self.centroids, self.probes = np.array(self.meta["centroids"], np.float64), self.meta["probes"]

    @classmethod
    def build(cls, df: DataFrame, path: str, cells: int = 16, id_col: str = "vec_id", vec_col: str = "embedding", **kw) -> StoredIvf:
        spark, index = df.sparkSession, IvfIndex(df, cells, id_col, vec_col, **kw)
        index.assigned.repartition("cell", F.pmod(F.xxhash64(id_col), F.lit(16))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        meta = {"id_col": id_col, "vec_col": vec_col, "centroids": index.centroids.tolist(), "probes": index.probes, "schema": df.schema.json()}
        scratch.save(spark, f"{path}/meta.json", meta)
        return cls(spark, path)

    @property
    def assigned(self) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self.meta["schema"])).add("cell", T.IntegerType())
        return self.spark.read.schema(schema).parquet(f"{self.path}/vectors")

    def stats(self) -> DataFrame:
        return stats(self.assigned, self.vec_col)


class VectorIndexes:
    """Named vector indexes of collections under one folder: inverted files, with product quantizers if asked for."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, collection: str, name: str) -> str:
        return f"{self.path}/{collection}/{name}"

    def create_index(self, df: DataFrame, collection: str, name: str, cells: int = 16, id_col: str = "vec_id", vec_col: str = "embedding", quantize: bool = False) -> StoredIvf:
        at = self._at(collection, name)
        if scratch.exists(self.spark, f"{at}/meta.json"):
            raise DuplicateKeyError(f"vector index {collection}.{name} is there already")
        if quantize:
            q = ProductQuantizer(max(1, dimensions(df, vec_col) // 8)).train(df, id_col, vec_col)
            q.encode(df, id_col, vec_col).write.mode("overwrite").parquet(f"{at}/codes")
            scratch.save(self.spark, f"{at}/books.json", q.books.tolist())
        return StoredIvf.build(df, at, cells, id_col, vec_col)

    def get(self, collection: str, name: str) -> StoredIvf:
        if not scratch.exists(self.spark, f"{self._at(collection, name)}/meta.json"):
            raise NotFoundError(f"no vector index {collection}.{name}")
        return StoredIvf(self.spark, self._at(collection, name))

    def quantizer(self, collection: str, name: str) -> tuple[ProductQuantizer, DataFrame]:
        at = self._at(collection, name)
        books = np.array(scratch.load(self.spark, f"{at}/books.json"))
        q = ProductQuantizer(len(books), books.shape[1])
        q.books, q.dims = books, books.shape[0] * books.shape[2]
        return q, self.spark.read.parquet(f"{at}/codes")

    def index(self, collection: str, name: str, new: DataFrame) -> None:
        """Add vectors, or replace those of ids that are there; the cells' centroids stay as they are."""
        store = self.get(collection, name)
        self._replace(store, put(store.assigned.drop("cell"), new.where(usable(store.vec_col, store.centroids.shape[1])), store.id_col))

    def remove(self, collection: str, name: str, ids: DataFrame) -> None:
        store = self.get(collection, name)
        self._replace(store, remove(store.assigned.drop("cell"), ids, store.id_col))

    def _replace(self, store: StoredIvf, rows: DataFrame) -> None:
        new = f"{store.path}/next"
        rows.withColumn("cell", _nearest(store.centroids, store.vec_col)).repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(new)
        scratch.delete(self.spark, f"{store.path}/vectors")
        scratch.rename(self.spark, new, f"{store.path}/vectors")

    def search(self, collection: str, name: str, query, k: int, filter_query=None) -> DataFrame:
        store = self.get(collection, name)
        rows = store.assigned.where(F.col("cell").isin(store._cells(query, None)))
        return knn(rows, query, k, id_col=store.id_col, vec_col=store.vec_col, filter_query=filter_query)

    def drop_index(self, collection: str, name: str) -> None:
        self.get(collection, name)
        scratch.delete(self.spark, self._at(collection, name))

    def list_indexes(self, collection: str) -> list[str]:
        return scratch.children(self.spark, f"{self.path}/{collection}")

    def stats(self, collection: str, name: str) -> dict:
        store = self.get(collection, name)
        row = store.stats().first()
        return {"vectors": row["n_vectors"], "dims": row["dims"], "cells": len(store.centroids), "probes": store.probes}


def _cell_order(v: pd.Series, centroids: np.ndarray) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype(np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
    return (centroids**2).sum(1)[None] - 2 * x @ centroids.T


def _nearest(centroids: np.ndarray, vec_col: str):
    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(np.argmin(_cell_order(v, centroids), axis=1).astype(np.int32) if len(v) else [], dtype="int32")

    return cell(F.col(vec_col))


def _nearest_cells(centroids: np.ndarray, vec_col: str, probes: int):
    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        return pd.Series([r.tolist() for r in np.argsort(_cell_order(v, centroids), axis=1, kind="stable")[:, :probes]] if len(v) else [], dtype=object)

    return cells(F.col(vec_col))


def kmeans(x: np.ndarray, k: int, rounds: int = 25, seed: int = 1) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster takes the point farthest from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = (x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T
        a = d.argmin(1)
        new = np.stack([x[a == i].mean(0) if (a == i).any() else x[d.min(1).argmax()] for i in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return c


class ProductQuantizer:
    """m subspaces of ``centroids`` codewords each, trained on at most ``sample`` vectors; every usable vector is encoded."""

    def __init__(self, m: int = 8, centroids: int = 256, rounds: int = 25, seed: int = 1, sample: int = SAMPLE):
        self.m, self.k, self.rounds, self.seed, self.sample = m, centroids, rounds, seed, sample

    def train(self, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> ProductQuantizer:
        x = _sample(df, id_col, vec_col, self.sample)
        self.dims = x.shape[1]
        if self.dims % self.m:
            raise ValueError("dimensions must be a multiple of m")
        w = self.dims // self.m
        self.books = np.stack([kmeans(x[:, i * w : (i + 1) * w], min(self.k, len(x)), self.rounds, self.seed + i) for i in range(self.m)])
        return self

    def encode_array(self, x: np.ndarray) -> np.ndarray:
        parts = x.reshape(len(x), self.m, -1)
        return np.stack([((parts[:, i, None] - b[None]) ** 2).sum(2).argmin(1) for i, b in enumerate(self.books)], 1)

    def decode_array(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[i][codes[:, i]] for i in range(self.m)], axis=1)

    def encode(self, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """(id, codes) of the vectors that are usable."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    s = b.slice(at, 1024)
                    codes = self.encode_array(np.array(s.column(1).to_pylist(), np.float64)) if s.num_rows else np.empty((0, self.m), int)
                    yield pa.RecordBatch.from_arrays([s.column(0), pa.array(codes.tolist(), pa.list_(pa.int32()))], names=[id_col, "codes"])

        return df.where(usable(vec_col, self.dims)).select(id_col, vec_col).mapInArrow(run, f"{id_col} bigint, codes array<int>")

    def distances(self, encoded: DataFrame, query, id_col: str = "vec_id") -> DataFrame:
        """(id, distance): the sum over subspaces of the query's Euclidean distance from the codeword, looked up in the JVM."""
        q = np.array(query, np.float64).reshape(self.m, -1)
        tables = np.sqrt(((self.books - q[:, None]) ** 2).sum(2))
        lookup = F.array(*[F.array(*map(F.lit, map(float, t))) for t in tables])
        parts = F.zip_with("codes", lookup, lambda c, t: F.element_at(t, c + 1))
        return encoded.select(id_col, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("distance"))

    def ratio(self) -> float:
        return self.dims * 4 / self.m


def put(store: DataFrame, new: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """An embedding store after writing ``new``: an id that exists is replaced, and counts once.

    An id that ``new`` repeats keeps its greatest row, by all columns in order.
    """
    cols = [c for c in store.columns if c != id_col]
    once = new.groupBy(id_col).agg(F.max(F.struct(*cols)).alias("_v")).select(id_col, "_v.*").select(store.columns)
    return store.join(new.select(id_col), id_col, "left_anti").unionByName(once)


def remove(store: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return store.join(ids.select(id_col), id_col, "left_anti")


def stats(store: DataFrame, vec_col: str = "embedding") -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("n_vectors"), F.max(F.size(vec_col)).alias("dims"))
