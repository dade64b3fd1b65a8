"""Language identification: unigram piece models over a fixed public vocabulary, summed over all segmentations.

A word's probability in a language is the sum, over every way to cut it into vocabulary
pieces, of the product of the pieces' probabilities (the forward algorithm); a text's is the
product over its words. Characters outside the vocabulary are covered by its byte pieces.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spread import spread
from .common import TOKENIZERS, map_arrow, table

VOCABULARY = f"{TOKENIZERS}/piece_bpe_32k.model"
#: Labelled rows of each language that the model is fitted on, at most.
SAMPLE_PER_LANG = 200
EM_ROUNDS = 3
SMOOTHING = 0.02
#: A document is accepted if it has a word and its language's posterior reaches this.
MIN_POSTERIOR = 0.7
SPACE = "▁"
#: Words scored together; words longer than this many characters are scored one by one, with rescaling.
LONG_WORD = 48
CACHE_WORDS = 300_000
#: Forward sums below this have left, or may have left, a double's range on the way; they are summed again in logarithms.
TINY = 1e-280

#: ASCII letters stay (lower-cased before), other ASCII becomes white space; bytes from 128 on are parts of letters.
_KEEP = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words_of(lowered: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and non-ASCII characters of a lower-cased UTF-8 text."""
    return lowered.translate(_KEEP).split()


def vocabulary(path: str) -> tuple[list[str], dict[int, int]]:
    """Text pieces, and the piece number of each byte's fallback; control pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, of_byte = [], {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        if sp.is_byte(i):
            of_byte[int(sp.id_to_piece(i)[3:5], 16)] = len(pieces)
            pieces.append("")
        else:
            pieces.append(sp.id_to_piece(i))
    return pieces, of_byte


@dataclass
class Model:
    langs: list[str]
    pieces: list[str]
    of_byte: dict[int, int]
    probs: np.ndarray  # pieces by languages

    def __post_init__(self):
        self.index = {p: i for i, p in enumerate(self.pieces) if p}
        self.longest = max(map(len, self.index))

    def edges(self, word: str) -> list[tuple[int, int, tuple[int, ...]]]:
        """(start, end, pieces) of every arc: a vocabulary piece, or the byte pieces of an unknown character."""
        text, out = SPACE + word, []
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + self.longest) + 1):
                k = self.index.get(text[i:j])
                if k is not None:
                    out.append((i, j, (k,)))
                elif j == i + 1:
                    out.append((i, j, tuple(self.of_byte[b] for b in text[i].encode())))
        return out

    def log_score(self, word: str) -> np.ndarray:
        """log of the forward sum of one word, for each language; rescaled as it goes, so of any length."""
        n, into = len(word) + 1, defaultdict(list)
        for i, j, ks in self.edges(word):
            into[j].append((i, np.prod(self.probs[list(ks)], axis=0)))
        alpha, scale = np.zeros((n + 1, len(self.langs))), np.zeros((n + 1, len(self.langs)))
        alpha[0] = 1
        for j in range(1, n + 1):
            top = np.max([scale[i] for i, _ in into[j]], axis=0)
            a = sum(alpha[i] * np.exp(scale[i] - top) * p for i, p in into[j])
            alpha[j], scale[j] = 1.0, top + np.log(a)
        return scale[n]

    def tables(self) -> None:
        """Hash tables of the pieces by length, for ``log_scores``."""
        if hasattr(self, "by_len"):
            return
        self.by_len = {}
        groups = defaultdict(list)
        for p, i in self.index.items():
            groups[len(p)].append((_hash_text(p), i))
        for n, items in groups.items():
            items.sort()
            self.by_len[n] = (np.array([h for h, _ in items], np.uint64), np.array([i for _, i in items], np.int64))

    def log_scores(self, words: list[str]) -> np.ndarray:
        """``log_score`` of many words at once."""
        out = np.empty((len(words), len(self.langs)))
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self.log_score(w)
        if not short:
            return out
        self.tables()
        short.sort(key=lambda i: -len(words[i]))
        texts = [SPACE + words[i] for i in short]
        lens = np.array([len(t) for t in texts])
        most = int(lens[0])
        codes = np.zeros((len(texts), most), np.uint64)
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        codes[np.arange(most)[None] < lens[:, None]] = flat
        pre = np.zeros((len(texts), most + 1), np.uint64)
        for j in range(most):
            pre[:, j + 1] = pre[:, j] * _BASE + codes[:, j] + np.uint64(1)
        alpha = np.zeros((most + 1, len(texts), len(self.langs)))
        alpha[0] = 1
        known1, id1 = self.by_len[1]
        for i in range(most):
            live = int(np.searchsorted(-lens, -i, side="left"))  # words longer than i come first
            a = alpha[i, :live]
            for n, (hashes, ids) in self.by_len.items():
                if i + n > most:
                    continue
                m = int(np.searchsorted(-lens, -(i + n), side="right"))
                if not m:
                    continue
                h = pre[:m, i + n] - pre[:m, i] * _POWERS[n]
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = np.nonzero(hashes[at] == h)[0]
                if len(hit):
                    alpha[i + n, hit] += a[hit] * self.probs[ids[at[hit]]]
                if n == 1 and len(hit) < m:
                    miss = np.ones(m, bool)
                    miss[hit] = False
                    for k in np.nonzero(miss)[0]:
                        alpha[i + 1, k] += a[k] * np.prod(self.probs[[self.of_byte[b] for b in texts[k][i].encode()]], axis=0)
        sums = alpha[lens, np.arange(len(texts))]
        out[short] = np.log(np.maximum(sums, TINY))
        for k in np.nonzero((sums < TINY).any(axis=1))[0]:
            out[short[k]] = self.log_score(words[short[k]])
        return out


_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64)) for n in range(64)]


def _hash_text(p: str) -> int:
    h = 0
    for ch in p:
        h = (h * 0x9E3779B97F4A7C15 + ord(ch) + 1) % (1 << 64)
    return h


def fit(counts: dict[str, Counter], path: str = VOCABULARY, rounds: int = EM_ROUNDS, smoothing: float = SMOOTHING) -> Model:
    """Piece probabilities of each language from its word counts, by expectation maximisation over all segmentations."""
    pieces, of_byte = vocabulary(path)
    langs = sorted(counts)
    model = Model(langs, pieces, of_byte, np.full((len(pieces), len(langs)), 1 / len(pieces)))
    for l, lang in enumerate(langs):
        words = sorted(counts[lang])
        many = np.array([counts[lang][w] for w in words], np.float64)
        p = np.full(len(pieces), 1 / len(pieces))
        arcs = _arcs(model, words) if words else None
        for _ in range(rounds if words else 0):
            got = _expected(arcs, many, p)
            p = (got + smoothing) / (got.sum() + smoothing * len(pieces))
        model.probs[:, l] = p
    return model


def _arcs(model: Model, words: list[str]):
    """All words' lattices in flat arrays: (nodes, first node, last node, word, arcs by start offset, arc pieces, piece ranges)."""
    model.tables()
    texts = [SPACE + w for w in words]
    size = np.array([len(t) for t in texts])
    node = np.cumsum(size + 1) - (size + 1)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    offset = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    power = np.multiply.accumulate(np.where(np.arange(len(codes) + 1) == 0, np.uint64(1), _BASE))
    back = np.multiply.accumulate(np.where(np.arange(len(codes)) == 0, np.uint64(1), np.uint64(pow(int(_BASE), -1, 1 << 64))))
    acc = np.concatenate([[np.uint64(0)], np.cumsum((codes + np.uint64(1)) * back, dtype=np.uint64)])
    starts, lens, ids = [], [], []
    known = np.zeros(len(codes), bool)
    for n, (hashes, of) in model.by_len.items():
        i = np.nonzero(offset + n <= size[word])[0]
        h = (acc[i + n] - acc[i]) * power[i + n - 1]
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[at] == h
        starts.append(i[hit])
        lens.append(np.full(int(hit.sum()), n))
        ids.append(of[at[hit]])
        if n == 1:
            known[i[hit]] = True
    start, step, piece = np.concatenate(starts), np.concatenate(lens), np.concatenate(ids)
    single = len(start)
    other = np.nonzero(~known)[0]
    spelled = [[model.of_byte[b] for b in chr(int(codes[i])).encode()] for i in other]
    start, step = np.concatenate([start, other]), np.concatenate([step, np.ones(len(other), np.int64)])
    per = np.concatenate([np.ones(single, np.int64), np.array([len(x) for x in spelled], np.int64)])
    piece = np.concatenate([piece, np.array([k for x in spelled for k in x], np.int64)])
    source = node[word[start]] + offset[start]
    order = np.argsort(offset[start], kind="stable")
    edge = np.searchsorted(offset[start][order], np.arange(int(size.max()) + 1))
    return int((size + 1).sum()), node, node + size, word[start], source, source + step, order, edge, piece, np.cumsum(per) - per, per


def _expected(arcs, many: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, by the forward and backward sums of every word."""
    nodes, first, last, word, source, target, order, edge, piece, at, per = arcs
    log_q = np.add.reduceat(np.log(p)[piece], at)
    q = np.exp(log_q)
    fwd, bwd = np.zeros(nodes), np.zeros(nodes)
    fwd[first] = bwd[last] = 1
    steps = [order[a:z] for a, z in zip(edge, edge[1:])]
    for e in steps:
        np.add.at(fwd, target[e], fwd[source[e]] * q[e])
    for e in reversed(steps):
        np.add.at(bwd, source[e], bwd[target[e]] * q[e])
    z = fwd[last]
    unit = np.divide(many, z, out=np.zeros_like(many), where=z >= TINY)
    use = fwd[source] * q * bwd[target] * unit[word]
    if (z < TINY).any():
        far = (z < TINY)[word]
        steps = [e[far[e]] for e in steps]
        fwd, bwd = np.full(nodes, -np.inf), np.full(nodes, -np.inf)
        fwd[first] = bwd[last] = 0
        for e in steps:
            np.logaddexp.at(fwd, target[e], fwd[source[e]] + log_q[e])
        for e in reversed(steps):
            np.logaddexp.at(bwd, source[e], bwd[target[e]] + log_q[e])
        use[far] = many[word[far]] * np.exp(fwd[source[far]] + log_q[far] + bwd[target[far]] - fwd[last[word[far]]])
    return np.bincount(piece, weights=np.repeat(use, per), minlength=len(p))


def training_counts(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, Counter]:
    """Word counts of at most ``per_lang`` labelled texts a language, chosen by the hash of their ids.

    A repeated id counts once a language, with its least text. Every word of a chosen text counts,
    whatever its length. Rows of a null id or language aren't labelled, and null texts have no
    words; a language without words keeps equal piece probabilities; no labels, as of an empty
    table, give no languages. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND id IS NOT NULL").distinct().withColumn("h", F.xxhash64("id", F.lit(17)))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    span = 1 << 63
    limit = None
    for lang, n in sizes.items():
        top = span if n <= 2 * per_lang else int(span * min(1.0, 2 * per_lang / n))
        limit = F.when(F.col("lang") == lang, F.lit(top - 1)) if limit is None else limit.when(F.col("lang") == lang, F.lit(top - 1))
    near = rows.where(F.col("h").bitwiseAND(F.lit(span - 1)) <= limit)
    order = F.transform(F.array_sort(F.collect_list(F.struct("h", "id"))), lambda x: x["id"])
    best = near.groupBy("lang").agg(F.slice(order, 1, per_lang).alias("ids"))
    picked = {(i, r["lang"]) for r in best.collect() for i in r["ids"]}
    texts = docs.where(F.col(id_col).isin(list({i for i, _ in picked})) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).groupBy(F.col(id_col), F.col(lang_col)).agg(F.min(text_col))
    counts: dict[str, Counter] = {lang: Counter() for lang in sizes}
    for i, lang, text in texts.toLocalIterator():
        if (i, lang) not in picked:
            continue
        counts[lang].update(w.decode("utf-8", "replace") for w in words_of(text.lower().encode()))
    return counts


def score_batch(model: Model, arr: pa.Array, cache: dict, table_: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(log scores by language, words) of each text; nulls have 0 words. ``cache``: word to row of ``table_[0]``."""
    lowered = pc.utf8_lower(arr).to_pylist()
    split = [words_of(t.encode()) if t else [] for t in lowered]
    flat = list(chain.from_iterable(split))
    distinct = set(flat)
    new = distinct - cache.keys()
    if new:
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            table_[0] = np.empty((0, len(model.langs)))
            new = distinct
        new = sorted(new)
        fresh = np.concatenate([model.log_scores([w.decode("utf-8", "replace") for w in new[i : i + 4096]]) for i in range(0, len(new), 4096)])
        base = len(table_[0])
        cache.update((w, base + i) for i, w in enumerate(new))
        table_[0] = np.concatenate([table_[0], fresh])
    n = np.array([len(ws) for ws in split], np.int64)
    rows = np.fromiter(map(cache.__getitem__, flat), np.int64, len(flat))
    total = np.zeros((len(split), len(model.langs)))
    has = np.nonzero(n)[0]
    if len(has):
        starts = (np.cumsum(n) - n)[has]
        total[has] = np.add.reduceat(table_[0][rows], starts, axis=0)
    return total, n


COLUMNS = "lang_pred string, posterior double, margin double, n_words bigint, accepted boolean"


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """(doc_id, lang_pred, posterior, margin, n_words, accepted) for every row; no shuffle.

    margin is the log odds a word of the best language against the second. A text without a
    word, a null one included, has no language and isn't accepted; equal scores go to the
    language first in order. Repeated rows stay; other columns are ignored. A model without
    languages accepts nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.pieces, model.of_byte, model.probs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        cache, tab = {}, [np.empty((0, len(m.langs)))]
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                score, n = score_batch(m, b.column(1), cache, tab)
                pred, post, margin, ok = _decide(m.langs, score, n, min_posterior)
                yield pa.RecordBatch.from_arrays([b.column(0), pred, post, margin, pa.array(n), ok], names=["doc_id", "lang_pred", "posterior", "margin", "n_words", "accepted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(spread(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))), run, f"doc_id {kind}, {COLUMNS}")


def _decide(langs: list[str], score: np.ndarray, n: np.ndarray, least: float):
    known = (n > 0) & (len(langs) > 0)
    if not len(langs):
        return pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.float64()), pa.nulls(len(n), pa.float64()), pa.array(np.zeros(len(n), bool))
    best = score.argmax(axis=1)
    top = score[np.arange(len(n)), best]
    post = 1 / np.exp(score - top[:, None]).sum(axis=1)
    second = np.partition(score, -2, axis=1)[:, -2] if len(langs) > 1 else top
    margin = (top - second) / np.maximum(n, 1)
    mask = ~known
    return (
        pa.array([langs[i] if k else None for i, k in zip(best, known)], pa.string()),
        pa.array(np.round(post, 6), pa.float64(), mask=mask),
        pa.array(np.round(margin, 6), pa.float64(), mask=mask),
        pa.array(known & (post >= least)),
    )


def accept(docs: DataFrame, model: Model, text_col: str = "text", min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """The rows of ``docs`` that ``identify`` accepts, all columns as they were, whatever their names.

    Null and empty texts and texts without a word go; texts of any length are scored whole; rows
    of null ids and repeated rows stay or go by their text; an empty table stays empty. Works
    within each partition.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.pieces, model.of_byte, model.probs))
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        cache, tab = {}, [np.empty((0, len(m.langs)))]
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                score, n = score_batch(m, b.column(where), cache, tab)
                yield b.filter(_decide(m.langs, score, n, min_posterior)[3])

    return map_arrow(spread(docs), run, docs.schema)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(training_counts(docs)))
