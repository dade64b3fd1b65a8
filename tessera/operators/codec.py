"""Run-length, LZ77 and Snappy codecs over binary columns."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rle_encode(data: bytes) -> bytes:
    """(count, byte) pairs with counts to 255, by whole arrays."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return b""
    start = np.concatenate([[0], np.nonzero(x[1:] != x[:-1])[0] + 1])
    run = np.diff(np.append(start, len(x)))
    pieces = -(-run // 255)
    last = np.cumsum(pieces) - 1
    count = np.full(int(pieces.sum()), 255)
    count[last] = run - 255 * (pieces - 1)
    return np.stack([count.astype(np.uint8), np.repeat(x[start], pieces)], 1).tobytes()


def rle_decode(data: bytes) -> bytes:
    x = np.frombuffer(data[: len(data) // 2 * 2], np.uint8).reshape(-1, 2)
    return np.repeat(x[:, 1], x[:, 0]).tobytes()


def lz77_encode(data: bytes, window: int = 255, least: int = 3) -> bytes:
    """Literals, and 0xFF distance length for the longest match of three bytes or more, of which the nearest; a literal 0xFF is 0xFF 0 0.

    Candidates come from a table of three-byte keys, so only places that match at all are compared.
    """
    out, i, seen, size = bytearray(), 0, {}, len(data)
    while i < size:
        best, length = 0, 0
        for at in reversed(seen.get(data[i : i + least], ())):
            if i - at > window or length == 255:
                break
            n, most = least, min(255, size - i)
            if length >= least and data[at + length : at + length + 1] != data[i + length : i + length + 1]:
                continue
            while n < most and data[at + n] == data[i + n]:
                n += 1
            if n > length:
                best, length = i - at, n
        step = length if length >= least else 1
        if length >= least:
            out += bytes((255, best, length))
        else:
            out += b"\xff\x00\x00" if data[i] == 255 else data[i : i + 1]
        for j in range(i, min(i + step, size - least + 1)):
            places = seen.setdefault(data[j : j + least], [])
            places.append(j)
            if len(places) > 2 * window:
                del places[:-window]
        i += step
    return bytes(out)


def lz77_decode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        if data[i] != 255 or i + 2 >= len(data):
            out.append(data[i])
            i += 1
        elif data[i + 1] == 0:
            out.append(255)
            i += 3
        else:
            start = len(out) - data[i + 1]
            for j in range(data[i + 2]):
                out.append(out[start + j])
            i += 3
    return bytes(out)


def _column(f: Callable[[bytes], bytes]) -> Callable[[Column], Column]:
    @F.pandas_udf(T.BinaryType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else f(bytes(b)))

    return lambda c: run(c.cast("binary"))


def snappy_encode(data: bytes) -> bytes:
    """The length in four bytes, least first, then a Snappy block."""
    return struct.pack("<I", len(data)) + pa.compress(data, codec="snappy", asbytes=True)


def snappy_decode(data: bytes) -> bytes:
    (size,) = struct.unpack_from("<I", data)
    return pa.decompress(data[4:], decompressed_size=size, codec="snappy", asbytes=True)


CODECS = {"snappy": (_column(snappy_encode), _column(snappy_decode)), "rle": (_column(rle_encode), _column(rle_decode)), "lz77": (_column(lz77_encode), _column(lz77_decode))}
