"""Token counts: batches balanced by bytes go to one batch-encoding call each; lengths only come out."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spread import spread
from .common import TOKENIZERS, map_arrow, table

#: Pre-token pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: UTF-8 bytes that one call to the encoder gets at most, but for a text without a safe boundary.
BATCH_BYTES = 1 << 20

_encoders: dict = {}


def encoder(path: str):
    """The worker's encoder of a rank file, loaded once."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def safe_pieces(text: str, limit: int = BATCH_BYTES) -> list[str]:
    """Cut a text into pieces of ``limit`` characters or a little more where no token can span.

    A cut goes before a single space between two characters that aren't white space: by the
    pattern a pre-token starts there in any case. A stretch without such a place stays whole.
    """
    out, start, n = [], 0, len(text)
    while n - start > limit:
        at = text.find(" ", start + limit)
        while at != -1 and (at + 1 >= n or text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at == -1:
            break
        out.append(text[start:at])
        start = at
    out.append(text[start:])
    return out


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def balanced(texts: list[str | None], limit: int = BATCH_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, pieces) batches of at most ``limit`` UTF-8 bytes each, but for single larger pieces; nulls and empty texts are left out."""
    rows, pieces, size = [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        # a piece of limit * characters / bytes characters has about limit bytes
        whole = n_bytes(t)
        for piece in [t] if whole <= limit else safe_pieces(t, max(1, limit * len(t) // whole)):
            n = whole if piece is t else n_bytes(piece)
            if pieces and size + n > limit:
                yield rows, pieces
                rows, pieces, size = [], [], 0
            rows.append(i)
            pieces.append(piece)
            size += n
    if pieces:
        yield rows, pieces


def token_counts(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) for every row: null for a null text, 0 for an empty one.

    Special tokens' strings are ordinary text. A long text is cut at safe boundaries and its
    pieces' counts are summed, so it counts whole. Repeated rows and null ids stay; an empty
    table gives no rows; other columns are ignored. No shuffle; memory is one Arrow batch and
    the ids of one encoded batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            counts = [None if t is None else 0 for t in texts]
            for rows, pieces in balanced(texts):
                for i, ids in zip(rows, enc.encode_ordinary_batch(pieces, num_threads=1)):
                    counts[i] += len(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(spread(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))), run, f"doc_id {kind}, n_tokens bigint")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
