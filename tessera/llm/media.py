"""Media columns: WAV bytes, short-time Fourier transforms and spectral-peak pair fingerprints."""

from __future__ import annotations

import io
import math
import struct
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spread import spread
from .common import map_arrow, table

RATE, FRAME, HOP = 8000, 512, 256
#: A peak is paired with the FAN next peaks at most SPAN frames later.
FAN, SPAN, NEAR = 5, 32, 3
#: Frames whose magnitudes a worker holds at once.
CHUNK_FRAMES = 2048


def wav_bytes(samples: np.ndarray, rate: int = RATE) -> bytes:
    """Mono 16-bit WAV of samples in [-1, 1]."""
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return buf.getvalue()


def _mono(raw: bytes, width: int, channels: int) -> np.ndarray:
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1) if len(x) and channels > 1 else x


def wav_samples(data: bytes | None, at_once: int) -> tuple[int, Iterator[np.ndarray]] | None:
    """(rate, mono samples in [-1, 1] by parts of ``at_once``) of 8-, 16-, 24- or 32-bit PCM; None for anything else."""
    if not data:
        return None
    try:
        w = wave.open(io.BytesIO(data))
        rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
    except (wave.Error, EOFError, struct.error):
        return None
    if width not in (1, 2, 3, 4) or channels < 1:
        return None
    return rate, (_mono(raw, width, channels) for raw in iter(lambda: w.readframes(at_once), b""))


def read_wav(data: bytes | None) -> tuple[int, np.ndarray] | None:
    """(rate, all samples) of ``wav_samples``."""
    got = wav_samples(data, 1 << 20)
    return None if got is None else (got[0], np.concatenate([np.empty(0), *got[1]]))


@lru_cache(maxsize=8)
def _hann(frame: int) -> np.ndarray:
    return np.hanning(frame)


def spectra(samples: Iterator[np.ndarray], frame: int = FRAME, hop: int = HOP, chunk: int = CHUNK_FRAMES) -> Iterator[np.ndarray]:
    """Magnitudes by parts of ``chunk`` frames, under a Hann window; a signal is padded with zeros to one frame or more and whole hops."""
    window, held = _hann(frame), np.empty(0)

    def magnitudes(x: np.ndarray, n: int) -> np.ndarray:
        return np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, frame)[::hop][:n] * window, axis=1))

    for x in samples:
        held = np.concatenate([held, x]) if len(held) else x
        while len(held) > frame + (chunk - 1) * hop:
            yield magnitudes(held, chunk)
            held = held[chunk * hop :]
    short = frame - len(held) if len(held) < frame else -(len(held) - frame) % hop
    held = np.concatenate([held, np.zeros(short)]) if short else held
    yield magnitudes(held, 1 + (len(held) - frame) // hop)


def spectrogram(x: np.ndarray, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Magnitudes of a whole signal, frames by frequency bins."""
    return np.concatenate(list(spectra(iter([x]), frame, hop)))


#: Neighbours of a cell, the nearest first, as they rule out most cells.
AROUND = sorted(((dt, df) for dt in range(-NEAR, NEAR + 1) for df in range(-NEAR, NEAR + 1) if dt or df), key=lambda x: (x[0] ** 2 + x[1] ** 2, x))


def peaks(mag: np.ndarray, mean: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of local maxima over NEAR frames and bins around that exceed the mean by three times; the first of equal neighbours wins."""
    wide = mag.shape[1] + 2 * NEAR
    held = np.full((mag.shape[0] + 2 * NEAR, wide), -1.0)
    held[NEAR:-NEAR, NEAR:-NEAR] = mag
    flat = held.ravel()
    at = np.flatnonzero(flat > 3 * (mag.mean() if mean is None else mean))
    top = flat[at]
    for dt, df in AROUND:
        other = flat[at + (dt * wide + df)]
        ok = top > other if (dt, df) < (0, 0) else top >= other
        at, top = at[ok], top[ok]
    return at // wide - NEAR, at % wide - NEAR


def streamed_peaks(parts: Iterator[np.ndarray], mean: float) -> tuple[np.ndarray, np.ndarray]:
    """``peaks`` of magnitudes that come in parts: a frame is judged once the NEAR frames after it are there."""
    held, start, done, found = next(parts), 0, 0, []
    while True:
        more = next(parts, None)
        upto = start + len(held) - (NEAR if more is not None else 0)
        if upto > done:
            t, f = peaks(held, mean)
            mine = (t + start >= done) & (t + start < upto)
            found.append((t[mine] + start, f[mine]))
            done = upto
        if more is None:
            return tuple(np.concatenate(x) for x in zip(*found))
        drop = max(0, done - NEAR - start)
        held, start = np.concatenate([held[drop:], more]), start + drop


def pairs(ts: np.ndarray, fs: np.ndarray) -> np.ndarray:
    """Sorted int64 codes ``frame << 32 | bin1 << 20 | bin2 << 8 | frames between`` of peak pairs."""
    out = []
    for k in range(1, FAN + 1):
        if len(ts) > k:
            dt = ts[k:] - ts[:-k]
            ok = dt <= SPAN
            out.append((ts[:-k].astype(np.int64) << 32 | fs[:-k].astype(np.int64) << 20 | fs[k:].astype(np.int64) << 8 | dt)[ok])
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)


def fingerprint(mag: np.ndarray) -> np.ndarray:
    """Peak pairs of a whole spectrogram."""
    return pairs(*peaks(mag))


def fingerprint_wav(data: bytes | None, chunk: int | None = None) -> tuple | None:
    """(rate, samples, frames, rms, fingerprint) of WAV bytes; None where they can't be read.

    A recording of any length passes in parts of ``chunk`` frames, twice if it has several, as
    peaks are held against the mean magnitude of the whole.
    """
    chunk = chunk or CHUNK_FRAMES
    if (got := wav_samples(data, chunk * HOP)) is None:
        return None
    n, squares, total, cells, frames, first = 0, 0.0, 0.0, 0, 0, None

    def counted(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        nonlocal n, squares
        for x in parts:
            n, squares = n + len(x), squares + float(np.dot(x, x))
            yield x

    for mag in spectra(counted(got[1]), chunk=chunk):
        first = mag if not frames else None
        frames, total, cells = frames + len(mag), total + float(mag.sum()), cells + mag.size
    again = iter([first]) if first is not None else spectra(wav_samples(data, chunk * HOP)[1], chunk=chunk)
    found = streamed_peaks(again, total / cells)
    return got[0], n, frames, round(math.sqrt(squares / n), 6) if n else 0.0, pairs(*found)


def tones(v: np.ndarray, seconds: float = 1.0, rate: int = RATE) -> np.ndarray:
    """A signal made from a vector: its entries, in turn, are amplitudes of short tones of rising and falling pitch."""
    n = int(seconds * rate) // max(len(v), 1)
    t = np.arange(n) / rate
    k = np.arange(len(v))
    freq = 200 + 3400 * ((k * 29) % max(len(v), 1)) / max(len(v), 1)
    scale = np.abs(v).max() if len(v) else 0
    return (np.nan_to_num(v / scale)[:, None] * np.sin(2 * np.pi * freq[:, None] * t[None])).ravel() if scale > 0 else np.zeros(n * len(v))


def media_of_embeddings(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(media_id, wav): a WAV column made from vectors of any length, as a stand-in for recordings.

    A null vector gives a null WAV, an empty or all-zero one silence; null and NaN entries are 0.
    Repeated rows and null ids stay; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                wavs = [None if v is None else wav_bytes(tones(np.array([x or 0.0 for x in v], np.float64))) for v in s.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(wavs, pa.binary())], names=["media_id", "wav"])

    return map_arrow(spread(vectors.select(F.col(f"`{id_col}`"), F.col(f"`{vec_col}`"))), run, f"media_id {vectors.schema[id_col].dataType.simpleString()}, wav binary")


def fingerprints(media: DataFrame, id_col: str = "media_id", wav_col: str = "wav") -> DataFrame:
    """(media_id, rate, n_samples, n_frames, rms, fingerprint) for every row, without a shuffle.

    Null or unreadable bytes, and samples of other than 8, 16, 24 or 32 bits, give nulls; silence
    gives an empty fingerprint; a signal of any length is read whole, in parts. Repeated rows and
    null ids stay; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int64()))
        for b in batches:
            rows = [fingerprint_wav(data.as_py()) or (None,) * 5 for data in b.column(1)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types))], names=["media_id", "rate", "n_samples", "n_frames", "rms", "fingerprint"])

    return map_arrow(media.select(F.col(f"`{id_col}`"), F.col(f"`{wav_col}`")), run, f"media_id {media.schema[id_col].dataType.simpleString()}, rate int, n_samples bigint, n_frames int, rms double, fingerprint array<bigint>")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(media_of_embeddings(table(spark, sf_dir, "embeddings")))
