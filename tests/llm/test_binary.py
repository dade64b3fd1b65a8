"""WARC and media."""

import random
import wave
from collections import Counter
from io import BytesIO

import numpy as np
import pytest

from tessera.llm import media, warc


def test_chunked_framing():
    for body in (b"", b"x", bytes(range(256)) * 20, b"\r\n0\r\n\r\n" * 9):
        for n in (1, 7, 1000):
            assert warc.dechunk(warc.chunked(body, n)) == body
    assert warc.dechunk(b"5;ext=1\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    for bad in (b"", b"5\r\nhel", b"zz\r\nhello\r\n0\r\n\r\n", b"5\r\nhelloXX0\r\n\r\n", b"5\r\nhello\r\n", b"-1\r\n"):
        assert warc.dechunk(bad) is None


def frame(spark, records):
    return spark.createDataFrame([(bytearray(r) if r is not None else None,) for r in records], "record binary")


def test_segments_come_together_in_any_order(spark):
    pages = [(1, "http://a", "<p>" + "é" * 3000), (2, None, "short"), (3, "http://c", ""), (None, "http://d\nx", "y" * 9000)]
    records = [r for p in pages for r in warc.records_of(*p, segment=500, chunk=64)]
    records += records[::3] + [None, b"", b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n", b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut"]
    random.Random(1).shuffle(records)
    got = warc.reassemble(warc.parsed(frame(spark, records).repartition(3))).collect()
    assert {(r["page"], r["uri"], bytes(r["body"]).decode()) for r in got} == {(p, u if u is None else u.replace("\n", " "), h) for p, u, h in pages}
    assert all(r["ok"] and r["status"] == 200 for r in got)


@pytest.mark.parametrize("lost", [0, 1, -1])
def test_a_lost_segment_is_noticed(spark, lost):
    records = warc.records_of(7, "http://a", "z" * 5000, segment=700)
    del records[lost]
    rows = warc.reassemble(warc.parsed(frame(spark, records))).collect()
    assert len(rows) == 1 and not rows[0]["ok"] and rows[0]["body"] is None


def test_a_wrong_total_length_is_noticed(spark):
    records = warc.records_of(7, "http://a", "z" * 5000, segment=700)
    n = records[-1].split(b"WARC-Segment-Total-Length: ")[1].split(b"\r\n")[0]
    records[-1] = records[-1].replace(b"Total-Length: " + n, b"Total-Length: " + str(int(n) + 1).encode())
    assert not warc.reassemble(warc.parsed(frame(spark, records))).first()["ok"]


@pytest.mark.parametrize("number", ["99999999999", "9" * 30, "0", "-1", "x", "", "²"])
def test_numbers_out_of_range_end_no_job(spark, number):
    records = warc.records_of(7, "http://a", "z" * 5000, segment=700)
    bad = records[1].replace(b"WARC-Segment-Number: 2", b"WARC-Segment-Number: " + number.encode())
    out = warc.reassemble(warc.parsed(frame(spark, [records[0], bad, *records[2:]]))).collect()
    assert [r["ok"] for r in out] == [False]
    n = records[-1].split(b"WARC-Segment-Total-Length: ")[1].split(b"\r\n")[0]
    last = records[-1].replace(b"Total-Length: " + n, b"Total-Length: " + number.encode())
    assert [r["ok"] for r in warc.reassemble(warc.parsed(frame(spark, [*records[:-1], last]))).collect()] == [False]
    cut = records[0].replace(b"Content-Length: ", b"Content-Length: " + number.encode())
    assert warc.parse(cut) is None or number in ("0", "")
    assert warc.dechunk(b"f" * 40 + b"\r\nx\r\n0\r\n\r\n") is None


def test_records_of_any_type_come_together(spark):
    body, out = b"some metadata " * 100, []
    for kind in ("resource", "request", "metadata"):
        name = f"<urn:{kind}>"
        out.append(warc.record([("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Segment-Number", 1)], body[:700]))
        out.append(warc.record([("WARC-Type", "continuation"), ("WARC-Record-ID", name + "2"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", 2), ("WARC-Segment-Total-Length", len(body))], body[700:]))
    got = warc.reassemble(warc.parsed(frame(spark, out))).collect()
    assert {r["origin"] for r in got} == {"<urn:resource>", "<urn:request>", "<urn:metadata>"}
    assert all(r["ok"] and bytes(r["body"]) == body and r["segments"] == 2 for r in got)


def test_negative_page_ids_and_other_columns_stay_whole(spark):
    pages = spark.createDataFrame([(-5, "u", "x" * 9000, "r", 1), (-(1 << 63), "v", "", "r", 1), ((1 << 63) - 1, None, "y", "r", 1)], "page_id bigint, url string, html string, record string, segment int")
    got = warc.reassemble(warc.parsed(warc.page_records(pages))).collect()
    assert {(r["page"], len(r["body"])) for r in got} == {(-5, 9000), (-(1 << 63), 0), ((1 << 63) - 1, 1)}


def test_op6_keeps_every_page(spark, sf):
    want = Counter((r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").distinct().collect() if r["html"] is not None)
    assert Counter((r["page_id"], r["url"], r["html"]) for r in warc.op6_warc(spark, sf).collect()) == want


def test_pages_round_trip(spark):
    rows = [(1, "u", "a" * 100_000, 5), (1, "u", "a" * 100_000, 5), (2, None, None, None), (3, "v", "", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, record int")
    out = warc.reassemble(warc.parsed(warc.page_records(pages))).collect()
    assert Counter((r["page"], len(r["body"]), r["ok"]) for r in out) == Counter([(1, 100_000, True), (3, 0, True)])
    assert warc.reassemble(warc.parsed(warc.page_records(pages.where("false")))).count() == 0


def wav(x, width, channels=1, rate=8000):
    buf = BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        if width == 1:
            raw = ((x * 127) + 128).astype(np.uint8).tobytes()
        elif width == 3:
            raw = b"".join(int(v * (2**23 - 1)).to_bytes(3, "little", signed=True) for v in x)
        else:
            raw = (x * (2 ** (8 * width - 1) - 1)).astype(f"<i{width}").tobytes()
        w.writeframes(raw)
    return buf.getvalue()


@pytest.mark.parametrize("width", [5, 6, 8, 16])
def test_odd_widths_give_nulls(spark, width):
    buf = BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0" * 480)
    raw = bytearray(buf.getvalue())
    raw[34:36] = (8 * width).to_bytes(2, "little")
    assert media.read_wav(bytes(raw)) is None and media.fingerprint_wav(bytes(raw)) is None
    rows = [(1, raw, "x", 1), (2, bytearray(wav(np.zeros(100), 2)), "x", 1)]
    df = spark.createDataFrame(rows, "media_id bigint, wav binary, rate string, fingerprint int")
    assert {(r["media_id"], r["rate"]) for r in media.fingerprints(df).collect()} == {(1, None), (2, 8000)}


@pytest.mark.parametrize("cut", range(0, 60, 4))
def test_cut_off_files_end_no_job(cut):
    got = media.fingerprint_wav(wav(np.zeros(100), 2)[:cut])
    assert got is None or got[1] <= 8


def brute_pairs(mag):
    """Pair codes of a spectrogram, by loops."""
    n, out, (t_max, f_max) = media.NEAR, set(), mag.shape
    least = 3 * mag.mean()
    found = []
    for t in range(t_max):
        for f in range(f_max):
            if mag[t, f] > least:
                near = [(a, b) for a in range(max(0, t - n), min(t_max, t + n + 1)) for b in range(max(0, f - n), min(f_max, f + n + 1))]
                if all(mag[a, b] < mag[t, f] if (a, b) < (t, f) else mag[a, b] <= mag[t, f] for a, b in near):
                    found.append((t, f))
    for i, (t, f) in enumerate(found):
        out |= {t << 32 | f << 20 | g << 8 | u - t for u, g in found[i + 1 : i + 1 + media.FAN] if u - t <= media.SPAN}
    return sorted(out)


@pytest.mark.parametrize("n", [0, 300, 512, 5000, 30_000])
def test_streamed_fingerprints_equal_brute_force(n):
    r = np.random.default_rng(n)
    x = np.concatenate([media.tones(r.standard_normal(64)) * 0.9, r.standard_normal(8000) * 0.2, np.zeros(6000), media.tones(r.standard_normal(16)) * 0.5])[:n]
    data = wav(x, 2)
    rate, y = media.read_wav(data)
    mag = media.spectrogram(y)
    want = brute_pairs(mag)
    for chunk in (1, 2, 5, 16, None):
        got = media.fingerprint_wav(data, chunk)
        assert got[:3] == (rate, len(y), len(mag)) and got[4].tolist() == want
        assert abs(got[3] - (np.sqrt(np.mean(y * y)) if n else 0)) < 1e-6
    assert n < 5000 or len(want) > 20


def test_op10_equals_brute_force(spark, sf):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = media.op10_media(spark, sf).collect()
    assert sorted(r["media_id"] for r in got) == sorted(vectors)
    for r in got[:25]:
        rate, x = media.read_wav(media.wav_bytes(media.tones(np.array(vectors[r["media_id"]], np.float64))))
        mag = media.spectrogram(x)
        assert (r["rate"], r["n_samples"], r["n_frames"]) == (rate, len(x), len(mag)) and r["fingerprint"] == brute_pairs(mag)


@pytest.mark.parametrize(("n", "frames"), [(0, 1), (511, 1), (512, 1), (513, 2), (767, 2), (768, 2), (8000, 31)])
def test_every_sample_is_in_a_frame(n, frames):
    x = np.zeros(n)
    x[-20:] = 1.0
    m = media.spectrogram(x)
    assert len(m) == frames and (n == 0 or m[-1].max() > 0)


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_reading_wav(width):
    x = np.sin(np.arange(800) / 9) * 0.8
    rate, y = media.read_wav(wav(x, width))
    assert rate == 8000 and np.abs(x - y).max() < (0.02 if width == 1 else 1e-3)
    stereo = np.repeat(x, 2)
    assert np.abs(media.read_wav(wav(stereo, width, 2))[1] - y).max() < 1e-9


def test_spectrum_and_peaks_against_brute_force():
    x = np.sin(2 * np.pi * 1000 * np.arange(8000) / 8000) + 0.5 * np.sin(2 * np.pi * 2500 * np.arange(8000) / 8000)
    m = media.spectrogram(x)
    k = np.arange(media.FRAME)
    for t, f in ((0, 64), (5, 160), (9, 33)):
        part = x[t * media.HOP : t * media.HOP + media.FRAME] * np.hanning(media.FRAME)
        assert abs(m[t, f] - abs((part * np.exp(-2j * np.pi * f * k / media.FRAME)).sum())) < 1e-6
    r = np.random.default_rng(3).random((20, 40)) ** 4
    n = media.NEAR
    want = [(t, f) for t in range(20) for f in range(40) if r[t, f] > 3 * r.mean() and all((r[t, f] > r[a, b]) if (a - t, b - f) < (0, 0) else r[t, f] >= r[a, b] for a in range(max(0, t - n), min(20, t + n + 1)) for b in range(max(0, f - n), min(40, f + n + 1)) if (a, b) != (t, f))]
    assert list(zip(*(v.tolist() for v in media.peaks(r)))) == want


def test_fingerprints_are_time_coded_and_survive_a_shift():
    r = np.random.default_rng(1)
    x = media.tones(r.standard_normal(64)) * 0.9
    a = media.fingerprint(media.spectrogram(x))
    b = media.fingerprint(media.spectrogram(np.concatenate([np.zeros(4 * media.HOP), x])))
    assert len(a) > 10 and (np.diff(a) > 0).all()
    low = (1 << 32) - 1
    shared = {(v & low, v >> 32) for v in a.tolist()} & {(v & low, (v >> 32) - 4) for v in b.tolist()}
    other = media.fingerprint(media.spectrogram(media.tones(r.standard_normal(64)) * 0.9))
    assert len(shared) > 0.6 * len(a) and len({v & low for v in other.tolist()} & {v & low for v in a.tolist()}) < len(shared)


def test_media_on_nasty_rows(spark):
    good = bytearray(wav(np.zeros(100), 2))
    rows = [(1, good), (1, good), (2, None), (3, bytearray(b"")), (4, bytearray(b"RIFFjunk")), (None, bytearray(wav(np.zeros(0), 2))), (5, bytearray(wav(np.tile(media.tones(np.arange(8.0)), 60), 2)))]
    got = media.fingerprints(spark.createDataFrame(rows, "media_id bigint, wav binary")).collect()
    assert len(got) == 7
    by = {r["media_id"]: r for r in got}
    assert by[1]["fingerprint"] == [] and by[2]["rate"] is None and by[3]["rate"] is None and by[4]["n_frames"] is None
    assert by[None]["n_samples"] == 0 and by[5]["n_samples"] == 480_000 and len(by[5]["fingerprint"]) > 100
    v = spark.createDataFrame([(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0])], "vec_id bigint, embedding array<float>")
    assert media.fingerprints(media.media_of_embeddings(v)).count() == 4
    assert media.fingerprints(media.media_of_embeddings(v.where("false"))).count() == 0
