"""Full-text search: postings, statistics, scoring, boolean and phrase queries, autocompletion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DuplicateKeyError, NotFoundError
from ..functions.text import ANALYZERS, BY_WORD, edge_ngram
from ..sources import scratch
from .spread import spread

K1, B = 1.5, 0.75
FIELD_GAP = 100


#: Folders that a stored index deals its terms to, by hash; a query reads those of its terms.
BUCKETS = 64
#: Documents of a folder's terms that one task writes, about, and those of all terms.
DOCS_A_TASK, DOCS_A_PART = 500_000, 5_000
#: Words of which a worker makes postings at once, and postings of a batch that it gives back.
WORDS_AT_ONCE, POSTS_A_BATCH = 1_000_000, 50_000
#: Words of which a worker remembers what they become.
WORDS_KNOWN = 500_000


def _terms(spark: SparkSession, analyzer: str, query: str) -> list[str]:
    """The query's terms; one local row through the index's own analyzer."""
    return spark.range(1).select(ANALYZERS[analyzer](F.lit(query)).alias("t")).first()["t"]


def _ranked(posts: DataFrame, stats: DataFrame, terms: list[str], among: DataFrame | None, score: str) -> DataFrame:
    """(doc, score, matched_terms) from the postings (doc, dl, term, wtf) of the query's terms; a repeated query term counts again."""
    repeats = {t: terms.count(t) for t in terms}
    # a row a query term, so its broadcast is bounded by the query
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if among is not None:
        posts = posts.join(among, "doc", "left_semi")
    qn = reduce(lambda acc, kv: F.when(F.col("term") == kv[0], F.lit(kv[1])).otherwise(acc), repeats.items(), F.lit(0))
    j = posts.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    part = bm25(F.col("wtf"), F.col("dl"), F.col("avgdl"), F.col("df"), F.col("n_docs")) if score == "bm25" else tf_idf(F.col("wtf"), F.col("dl"), F.col("df"), F.col("n_docs"))
    return j.groupBy("doc").agg(F.sum(part * qn).alias("score"), F.array_sort(F.collect_set("term")).alias("matched_terms"))


class StoredTextIndex:
    """Postings on disk, in folders by a hash of their term and sorted by term, with lengths and totals.

    Every query reads only the folders of its own terms, and in them only the row groups that
    can hold these; texts are analyzed once, when the index is built. A posting carries its
    document's length, so scoring joins nothing that grows with the collection.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.meta = spark, path, scratch.load(spark, f"{path}/meta.json")
        self.analyzer = self.meta["analyzer"]

    @classmethod
    def build(cls, index: TextIndex, path: str, buckets: int = BUCKETS) -> StoredTextIndex:
        """Write an index. A document's postings are made where its text is read, and are shuffled once,
        by bucket and a part of the documents, so that a hot term's postings come from many tasks.
        """
        spark = index.docs.sparkSession
        times = index.docs.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
        row = times.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
        n_docs, repeated = row[0], (row[1] or 0) > 1
        posts = index._posted(times.where("n > 1").select("doc") if repeated else None)
        salts = max(1, -(-n_docs // DOCS_A_TASK))
        tasks = buckets * salts if salts > 1 else min(buckets, max(spark.sparkContext.defaultParallelism, n_docs // DOCS_A_PART))
        bucket, tf = _bucket(F.col("term"), buckets), F.size("positions")
        task = F.pmod(bucket * salts + F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"), F.lit(tasks))
        # what follows from other columns isn't shuffled
        weighted = any(index.weights.get(f, 1.0) != 1.0 for f in index.fields)
        posts = posts.drop("tf", *[] if weighted else ["wtf"]).repartitionById(tasks, task)
        posts = posts.select("term", "doc", "dl", tf.cast("bigint").alias("tf"), "positions", F.col("wtf") if weighted else tf.cast("double").alias("wtf"), bucket.alias("bucket"))
        posts.sortWithinPartitions("bucket", "term", "doc").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        kind = index.docs.schema["doc"].dataType.simpleString()
        written = spark.read.schema("tf bigint").parquet(f"{path}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
        meta = {"analyzer": index.analyzer, "fields": index.fields, "weights": index.weights, "buckets": buckets, "doc": kind, "n_docs": n_docs, "avgdl": written / n_docs if n_docs else None}
        scratch.save(spark, f"{path}/meta.json", meta)
        return cls(spark, path)

    @property
    def _all(self) -> DataFrame:
        return self.spark.read.schema(f"term string, doc {self.meta['doc']}, dl int, tf bigint, positions array<int>, wtf double, bucket int").parquet(f"{self.path}/postings")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        if terms is None:
            return self._all.drop("bucket")
        if not terms:
            return self._all.where(F.lit(False)).drop("bucket")
        few = sorted(set(terms))
        buckets = self.spark.range(1).select(F.array_sort(F.array_distinct(F.array(*[_bucket(F.lit(t), self.meta["buckets"]) for t in few]))).alias("b")).first()["b"]
        return self._all.where(F.col("bucket").isin(buckets) & F.col("term").isin(few)).drop("bucket")

    def lengths(self) -> DataFrame:
        """(doc, dl) of the documents that have a term."""
        return self._all.groupBy("doc").agg(F.max("dl").alias("dl"))

    def stats(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(self.meta["n_docs"]).cast("bigint").alias("n_docs"), F.lit(self.meta["avgdl"]).cast("double").alias("avgdl"))

    def vocabulary(self) -> DataFrame:
        return self._all.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))

    def without(self, ids: DataFrame) -> DataFrame:
        return self.postings().join(ids.toDF("doc"), "doc", "left_anti")

    def terms_of(self, query: str) -> list[str]:
        return _terms(self.spark, self.analyzer, query)

    def boolean_and(self, terms: list[str]) -> DataFrame:
        hits = self.postings(terms).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
        return hits.where(F.col("n") == len(set(terms))).select("doc")

    def boolean_or(self, terms: list[str]) -> DataFrame:
        return self.postings(terms).select("doc").distinct()

    def phrase(self, terms: list[str]) -> DataFrame:
        """Documents where the terms stand at consecutive positions: places less their offset, in common to all terms."""
        few = sorted(set(terms))
        at = {t: F.col(f"p{few.index(t)}") for t in few}
        docs = self.postings(terms).groupBy("doc").agg(*[F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"p{i}") for i, t in enumerate(few)]) if few else self.postings([]).select("doc")
        if not few:
            return docs

        def starts(term: str, i: int) -> Column:
            return F.transform(at[term], lambda p: p - i)

        common = reduce(F.array_intersect, [starts(t, i) for i, t in enumerate(terms)])
        return docs.where(F.coalesce(F.size(common), F.lit(0)) > 0).select("doc")

    def scored(self, terms: list[str], among: DataFrame | None = None, score: str = "bm25") -> DataFrame:
        return _ranked(self.postings(terms), self.stats(), terms, among, score)

    def search(self, query: str, limit: int = 10, score: str = "bm25") -> DataFrame:
        return self.scored(self.terms_of(query), score=score).orderBy(F.desc("score"), "doc").limit(limit)

    def phrase_search(self, query: str, limit: int = 10) -> DataFrame:
        terms = self.terms_of(query)
        return self.scored(terms, self.phrase(terms)).orderBy(F.desc("score"), "doc").limit(limit)


def _postings(word: Callable[[bytes], bytes | None] | None, weights: list[float]):
    """(doc, words of each field) to (doc, dl, term, tf, positions, wtf) rows, in order of terms; ``word`` makes a term of a word, or None to leave it out."""
    becomes: dict[bytes, bytes | None] = {}

    def made(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codes: dict[bytes, int] = {}
        base, dl, got = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), []
        for i, weight in enumerate(weights):
            col = b.column(i + 1)
            words = col.flatten().dictionary_encode()
            code = np.empty(len(words.dictionary) + 1, np.int64)
            code[-1] = -2  # a null word has a place and no posting
            for k, w in enumerate(words.dictionary.cast(pa.binary()).to_pylist()):
                if word is not None:
                    if w not in becomes:
                        becomes[w] = word(w)
                    w = becomes[w]
                code[k] = -1 if w is None else codes.setdefault(w, len(codes))
            code = code[words.indices.fill_null(len(words.dictionary)).to_numpy()]
            doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(col).to_numpy())
            doc, code = doc[code != -1], code[code != -1]
            count = np.bincount(doc, minlength=b.num_rows)
            pos = np.arange(len(doc)) + (base - np.cumsum(count) + count)[doc]
            base, dl = base + count + FIELD_GAP, dl + count
            got.append((doc[code >= 0], code[code >= 0], pos[code >= 0], np.full(int((code >= 0).sum()), weight)))
        doc, code, pos, weight = (np.concatenate(x) for x in zip(*got))
        if not len(doc):
            return
        if len(got) > 1:
            order = np.argsort(doc, kind="stable")
            doc, code, pos, weight = doc[order], code[order], pos[order], weight[order]
        terms = sorted(codes)
        rank = np.empty(len(terms), np.int64)
        rank[[codes[t] for t in terms]] = np.arange(len(terms))
        order = np.sort(rank[code] << 32 | np.arange(len(code))) & 0xFFFFFFFF
        doc, code, pos = doc[order], rank[code[order]], pos[order].astype(np.int32)
        first = np.nonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]))[0]
        edge = np.append(first, len(doc))
        of = doc[first]
        cols = {
            "doc": b.column(0).take(pa.array(of)),
            "dl": pa.array(dl[of].astype(np.int32)),
            "term": pa.array(terms, pa.binary()).cast(pa.string(), safe=False).take(pa.array(code[first])),
            "tf": pa.array(np.diff(edge)),
            "positions": pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(pos)),
            "wtf": pa.array(np.add.reduceat(weight[order], first)),
        }
        out = pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
        for at in range(0, out.num_rows, POSTS_A_BATCH):
            yield out.slice(at, POSTS_A_BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = np.cumsum(sum(pc.list_value_length(b.column(i + 1)).to_numpy().astype(np.int64) for i in range(len(weights))))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(words, (words[at - 1] if at else 0) + WORDS_AT_ONCE, side="right")))
                yield from made(b.slice(at, to - at))
                at = to
                if len(becomes) > WORDS_KNOWN:
                    becomes.clear()

    return run


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class TextIndexes:
    """Named text indexes of collections under one folder; they outlive the process."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, collection: str, name: str) -> str:
        return f"{self.path}/{collection}/{name}"

    def create_index(self, df: DataFrame, collection: str, name: str, id_col: str, fields: list[str], analyzer: str = "standard", weights: dict[str, float] | None = None, buckets: int = BUCKETS) -> StoredTextIndex:
        if scratch.exists(self.spark, f"{self._at(collection, name)}/meta.json"):
            raise DuplicateKeyError(f"text index {collection}.{name} is there already")
        return StoredTextIndex.build(TextIndex(df, id_col, fields, analyzer, weights), self._at(collection, name), buckets)

    def get(self, collection: str, name: str) -> StoredTextIndex:
        if not scratch.exists(self.spark, f"{self._at(collection, name)}/meta.json"):
            raise NotFoundError(f"no text index {collection}.{name}")
        return StoredTextIndex(self.spark, self._at(collection, name))

    def drop_index(self, collection: str, name: str) -> None:
        self.get(collection, name)
        scratch.delete(self.spark, self._at(collection, name))

    def list_indexes(self, collection: str) -> list[str]:
        return scratch.children(self.spark, f"{self.path}/{collection}")

    def search(self, collection: str, name: str, query: str, limit: int = 10) -> DataFrame:
        return self.get(collection, name).search(query, limit)

    def stats(self, collection: str, name: str) -> dict:
        index = self.get(collection, name)
        return {"documents": index.meta["n_docs"], "terms": index._all.select("term").distinct().count(), "avg_length": index.meta["avgdl"], "bytes": scratch.size(self.spark, index.path)}


class TextIndex:
    """Postings of a collection worked out from its texts: (doc, term, tf, positions), with document lengths.

    Several fields are put one after another with a gap in positions, so that no phrase spans
    two. For a query or two over a collection that isn't stored; every query analyzes all texts
    (``StoredTextIndex.build`` does so once).
    """

    def __init__(self, df: DataFrame, id_col: str, fields: list[str], analyzer: str = "standard", weights: dict[str, float] | None = None):
        self.id_col, self.fields, self.analyzer = id_col, fields, analyzer
        self.weights = weights or {}
        analyze = ANALYZERS[analyzer]

        def tagged(toks: Column, base: Column, i: int) -> Column:
            return F.transform(toks, lambda w, k: F.struct(w.alias("term"), (k + base).alias("pos"), F.lit(i).alias("field")))

        parts, base = [], F.lit(0)
        for i, f in enumerate(fields):
            toks = F.coalesce(analyze(F.col(f)), F.array().cast("array<string>"))
            parts.append(tagged(toks, base, i))
            base = base + F.size(toks) + FIELD_GAP
        rows = self._rows = spread(df.select(id_col, *[f for f in fields if f != id_col]))
        self.docs = rows.select(F.col(id_col).alias("doc"), F.concat(*parts).alias("tokens"))
        # outer, as Spark would otherwise analyze each text once more to test for an empty array
        self.tokens = self.docs.select("doc", F.inline_outer("tokens")).where(F.col("term").isNotNull())

    def lengths(self) -> DataFrame:
        return self.docs.select("doc", F.size("tokens").alias("dl"))

    def stats(self) -> DataFrame:
        """n_docs, avgdl in one row."""
        return self.lengths().agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))

    def vocabulary(self) -> DataFrame:
        return self.tokens.groupBy("term").agg(F.count_distinct("doc").alias("df"), F.count(F.lit(1)).alias("cf"))

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        t = self.tokens if terms is None else self.tokens.where(F.col("term").isin(terms) if terms else F.lit(False))
        return t.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"), F.sum(self._weight(F.col("field"))).alias("wtf"))

    def _posted(self, repeated: DataFrame | None = None) -> DataFrame:
        """(doc, dl, term, tf, positions, wtf), made a document at a time without a shuffle; only texts of the ids in ``repeated`` (doc) are then folded by id and length."""
        split, word = BY_WORD.get(self.analyzer, (ANALYZERS[self.analyzer], None))
        none = F.array().cast("array<string>")
        rows = self._rows.select(F.col(self.id_col).alias("doc"), *[F.coalesce(split(F.col(f)), none).alias(f"words_{i}") for i, f in enumerate(self.fields)])
        make = _postings(word, [float(self.weights.get(f, 1.0)) for f in self.fields])
        schema = f"doc {self.docs.schema['doc'].dataType.simpleString()}, dl int, term string, tf bigint, positions array<int>, wtf double"
        if repeated is None:
            return rows.mapInArrow(make, schema)
        ids = repeated.toDF("_id")
        once, more = (rows.join(ids, rows["doc"].eqNullSafe(ids["_id"]), how).mapInArrow(make, schema) for how in ("left_anti", "left_semi"))
        folded = more.groupBy("doc", "dl", "term").agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"), F.sum("wtf").alias("wtf"))
        return once.unionByName(folded)

    def _weight(self, field: Column) -> Column:
        return reduce(lambda acc, i: F.when(field == i, F.lit(float(self.weights.get(self.fields[i], 1.0)))).otherwise(acc), range(len(self.fields)), F.lit(1.0))

    def without(self, ids: DataFrame) -> DataFrame:
        return self.tokens.join(ids, self.tokens["doc"] == ids[ids.columns[0]], "left_anti")

    def terms_of(self, query: str) -> list[str]:
        return _terms(self.docs.sparkSession, self.analyzer, query)

    def boolean_and(self, terms: list[str]) -> DataFrame:
        hits = self.tokens.where(F.col("term").isin(terms)).groupBy("doc").agg(F.count_distinct("term").alias("n"))
        return hits.where(F.col("n") == len(set(terms))).select("doc")

    def boolean_or(self, terms: list[str]) -> DataFrame:
        return self.tokens.where(F.col("term").isin(terms)).select("doc").distinct()

    def phrase(self, terms: list[str]) -> DataFrame:
        """Documents where the terms stand at consecutive positions."""
        if not terms:
            return self.docs.select("doc").where(F.lit(False))

        def starts(tokens: Column, i: int, term: str) -> Column:
            return F.transform(F.filter(tokens, lambda x: x["term"] == term), lambda x: x["pos"] - i)

        # bound to a lambda's variable, so that a text is analyzed once and not once a term
        hits = F.transform(F.array("tokens"), lambda tokens: F.size(reduce(F.array_intersect, (starts(tokens, i, t) for i, t in enumerate(terms)))))
        return self.docs.where(F.element_at(hits, 1) > 0).select("doc")

    def scored(self, terms: list[str], among: DataFrame | None = None, score: str = "bm25") -> DataFrame:
        """``_ranked`` over one scan, which takes the terms' occurrences and the lengths together; only those occurrences are shuffled."""
        hits = F.filter("tokens", lambda x: x["term"].isin(sorted(set(terms))) if terms else F.lit(False))
        found = self.docs.select("doc", F.size("tokens").alias("dl"), F.explode_outer(hits).alias("t")).where(F.col("t").isNotNull())
        posts = found.groupBy("doc", "dl", F.col("t.term").alias("term")).agg(F.sum(self._weight(F.col("t.field"))).alias("wtf"))
        return _ranked(posts, self.stats(), terms, among, score)

    def search(self, query: str, limit: int = 10, score: str = "bm25") -> DataFrame:
        return self.scored(self.terms_of(query), score=score).orderBy(F.desc("score"), "doc").limit(limit)

    def phrase_search(self, query: str, limit: int = 10) -> DataFrame:
        terms = self.terms_of(query)
        return self.scored(terms, self.phrase(terms)).orderBy(F.desc("score"), "doc").limit(limit)


def autocomplete(df: DataFrame, id_col: str, text_col: str, prefix: str, limit: int = 10) -> DataFrame:
    """Documents with a word that shares a prefix of two characters or more with the typed word, at score 1."""
    typed = [prefix.lower()[:n] for n in range(2, len(prefix) + 1)]
    hits = df.where(F.arrays_overlap(edge_ngram(F.col(text_col), 2, max(2, len(prefix.encode()))), F.array(*map(F.lit, typed)))) if typed else df.where(F.lit(False))
    return hits.select(F.col(id_col).alias("doc"), F.lit(1.0).alias("score")).orderBy("doc").limit(limit)


def bm25(tf: Column, dl: Column, avgdl: Column, df: Column, n: Column) -> Column:
    idf = F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))
    return idf * (tf * F.lit(K1 + 1)) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / avgdl))


def tf_idf(tf: Column, dl: Column, df: Column, n: Column) -> Column:
    return F.when((dl > 0) & (df > 0), tf / dl * F.log(n / df)).otherwise(F.lit(0.0))
