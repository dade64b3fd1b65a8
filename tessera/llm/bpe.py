"""Byte-level BPE encoding and decoding over Arrow batches.

Pre-tokens never merge with each other, so each distinct pre-token of a batch is encoded once
by the tokenizers library and texts are put together from the results. Offsets come from the
token byte lengths and a byte-to-character map of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spread import spread
from .common import TOKENIZERS, map_arrow, table
from .token_counts import PATTERN

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.json"
CACHE_WORDS = 200_000
#: Characters encoded together.
BATCH_CHARS = 1 << 20
#: Pre-tokens given to the library at once.
TOGETHER = 8192


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary, one per worker."""

    _loaded: dict = {}

    @classmethod
    def get(cls, path: str) -> Codec:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.find = regex.compile(PATTERN).findall
        back = byte_chars()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        words = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            words[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        self.words = words
        self.lens = np.array([len(w) for w in words], np.int64)
        self.flat = np.frombuffer(b"".join(words), np.uint8)
        self.at = np.cumsum(self.lens) - self.lens
        self.clear()

    def clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.ids, self.first, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids of each)."""
        split = [self.find(t) for t in texts]
        flat = list(chain.from_iterable(split))
        distinct = set(flat)
        new = distinct - self.cache.keys()
        if new:
            if len(self.cache) + len(new) > CACHE_WORDS:
                self.clear()
                new = distinct
            # words of letters after a space stay apart when joined, and go through in long strings
            plain = [w for w in new if w[0] == " " and w[1:].isalpha()]
            other = [w for w in new if not (w[0] == " " and w[1:].isalpha())]
            new = plain + other
            ids, size = self._encode_joined(plain)
            # few at once, as the library's results are much larger than the ids in them
            coded = [e.ids for i in range(0, len(other), TOGETHER) for e in self.tok.encode_batch_fast(other[i : i + TOGETHER], add_special_tokens=False)]
            size = np.concatenate([size, np.fromiter(map(len, coded), np.int64, len(coded))])
            base, count = len(self.ids), len(self.first)
            self.ids = np.concatenate([self.ids, ids, np.array([i for c in coded for i in c], np.int32)])
            self.first = np.concatenate([self.first, base + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.cache.update((w, count + k) for k, w in enumerate(new))
        per = np.fromiter(map(len, split), np.int64, len(split))
        rows = np.fromiter(map(self.cache.__getitem__, flat), np.int64, len(flat))
        size = self.size[rows]
        ids = self.ids[_ranges(self.first[rows], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        edge = np.concatenate([[0], np.cumsum(per)])
        return ids, ends[edge[1:]] - ends[edge[:-1]]

    def _encode_joined(self, words: list[str], together: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids of each word) of words that are pre-tokens of their joined text too."""
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        texts = ["".join(words[i : i + together]) for i in range(0, len(words), together)]
        ids = np.concatenate([np.array(e.ids, np.int32) for i in range(0, len(texts), 16) for e in self.tok.encode_batch_fast(texts[i : i + 16], add_special_tokens=False)])
        ends = np.cumsum([len(w.encode()) for w in words])
        last = np.searchsorted(np.cumsum(self.lens[ids]), ends) + 1
        return ids, np.diff(last, prepend=0)

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids in a row, through the reversed byte table."""
        return self.flat[_ranges(self.at[ids], self.lens[ids])]

    def decode(self, ids) -> str:
        """The text of a list of ids. Characters split over tokens are put together; bytes that never become a character give U+FFFD."""
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for size[0] numbers, then the same of the next."""
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0, dtype=np.int64) + np.repeat(first - (end - size), size)


def offsets(codec: Codec, ids: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one character of each token in ``data``, UTF-8 bytes that the ids encode.

    A token that has only a part of a character covers that character, as do its neighbours.
    """
    number = np.cumsum((data & 0xC0) != 0x80, dtype=np.int64) - 1
    end = np.cumsum(codec.lens[ids])
    return number[end - codec.lens[ids]], number[end - 1] + 1


def _groups(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, steps, widths, round_trip) for every row, without a shuffle.

    Character offsets are stored small: ``steps`` is each token's first character less that of
    the token before (or 0), ``widths`` the characters it covers; ``with_offsets`` gives them
    in full. round_trip says that decoding ``ids`` gave the text's bytes. A null text gives
    nulls, an empty one empty arrays; a text of any length is encoded whole. Special tokens'
    strings are ordinary text. Repeated rows and null ids stay; an empty table gives no rows;
    other columns are ignored.
    """
    kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int16()), pa.list_(pa.int16()), pa.bool_())
    names = ["doc_id", "n_tokens", "ids", "steps", "widths", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.get(vocabulary)
        try:
            yield from coded(codec, batches)
        finally:
            codec.clear()  # the worker lives on

    def coded(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            every = whole.column(1).to_pylist()
            for lo, hi in _groups(every, BATCH_CHARS):
                null = np.array([t is None for t in every[lo:hi]])
                # copies that stand together, as a mixture's do, are encoded once
                place: dict[str, int] = {}
                which = np.array([place.setdefault(t or "", len(place)) for t in every[lo:hi]])
                texts = list(place)
                ids, n = codec.encode(texts)
                raw = [t.encode() for t in texts]
                data = np.frombuffer(b"".join(raw), np.uint8)
                back = codec.decode_bytes(ids)
                sizes = np.fromiter(map(len, raw), np.int64, len(raw))
                edge = np.concatenate([[0], np.cumsum(n)])
                if len(back) == len(data) and (back == data).all():
                    same = np.ones(len(raw), bool)
                else:
                    same = np.array([codec.decode_bytes(ids[a:z]).tobytes() == r for a, z, r in zip(edge, edge[1:], raw)])
                if len(ids):
                    start, stop = offsets(codec, ids, data)
                    step = np.diff(start, prepend=0)
                    chars = np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)
                    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
                    has = np.nonzero(n)[0]
                    step[edge[has]] = start[edge[has]] - (chars[first[has]] - 1)
                    width = stop - start
                else:
                    step = width = np.empty(0, np.int64)
                if len(texts) < len(which):
                    rows = _ranges(edge[which], n[which])
                    ids, step, width, n, same = ids[rows], step[rows], width[rows], n[which], same[which]
                    edge = np.concatenate([[0], np.cumsum(n)])
                at = pa.array(np.where(np.concatenate([null, [False]]), 0, edge).astype(np.int32), mask=np.concatenate([null, [False]]))
                lists = [pa.ListArray.from_arrays(at, pa.array(v, k.value_type)) for v, k in ((ids, kinds[1]), (step.astype(np.int16), kinds[2]), (width.astype(np.int16), kinds[3]))]
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(lo, hi - lo), pa.array(n, pa.int64(), mask=null), *lists, pa.array(same, mask=null)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(spread(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))), run, f"doc_id {kind}, n_tokens bigint, ids array<int>, steps array<smallint>, widths array<smallint>, round_trip boolean")


def with_offsets(encoded: DataFrame) -> DataFrame:
    """(doc_id, ids, starts, ends): the characters [start, end) of each token, from steps and widths.

    Nulls give nulls and empty arrays empty ones; repeated rows and null ids stay; an empty table
    gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, ends = [], []
            for s, w in zip(b.column(2), b.column(3)):
                at = np.cumsum(s.values.to_numpy(), dtype=np.int32) if s.is_valid else None
                starts.append(at)
                ends.append(at + w.values.to_numpy() if s.is_valid else None)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(starts, kind), pa.array(ends, kind)], names=["doc_id", "ids", "starts", "ends"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_arrow(encoded.select("doc_id", "ids", "steps", "widths"), run, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of encoded rows; null token ids give a null text, no token ids an empty one.

    A character whose last bytes are missing becomes U+FFFD. Repeated rows and null document ids
    stay; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.get(vocabulary)
        for b in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select(F.col(id_col), F.col(ids_col)), run, f"doc_id {encoded.schema[id_col].dataType.simpleString()}, text string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
