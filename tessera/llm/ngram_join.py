"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

A document is the set of its hashed word n-grams; all documents of one set are one unit, joined
once. Sets are put in bands of sizes within a factor of the threshold. For a band, at most H
n-grams differ between any two sets that reach the threshold, the smaller being in the band.
The n-gram universe is hashed into m segments, and two sets whose segments all differ by more
than one n-gram differ by at least 2m. So with m > H / 2 some segments of a pair differ by at
most one: the segments' subsets are equal, or one is the other less an element, and a subset
meets a one-deletion neighbour.

Segments of one n-gram or none match by chance and aren't signed. A match that is lost this way
has both subsets that small, or differs by one n-gram exactly, so that sets which leave out x
and y segments lose (x + y) / 2 of their guaranteed matches. Each set may leave out as many as
m, its size and its partners' sizes allow; one with more of them leaves out none, and counts
what its partners leave out in full.

A band's segments are dealt to groups of about ``GROUP`` segments, and each set has for each
group the parity of its n-grams there in 128 bits. In some group of a pair that reaches the
threshold d n-grams differ, with d below twice the group's segments less those left out: else
they would sum up to more than H. Such a group holds a match, and at most d bits of the parities
differ. So a pair is passed on by each group where it has a match and so few different bits, and
chance matches go where they are found: what is passed on doesn't grow with the square of the
corpus. Where a group overfills a bucket it is split by signature. Pairs that were passed on are
then verified on the whole sets.

Bands are matched in rounds of about equal volume, up to ``ROUNDS`` for large tables, and each
round's shuffle files are deleted at its end, so that only a round's signatures are on disk at
once.

Signatures travel in packed binary blocks, one a batch and bucket, so that the shuffle carries
about four bytes a signature and no row a signature. When verifying, 64 bits stand for an n-gram
and two independent 64-bit sums for a set: two sets of 20,000 n-grams have a clash between them
with a chance of 2e-11, and among 10^10 different sets two are taken for one with a chance of
2e-19. Candidates go by the first sum alone; where two sets share that, each is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.spread import spread
from .common import map_arrow, small, table, trim, written

NGRAM = 2
THRESHOLD = Fraction(7, 10)
#: Signatures that a worker gathers before it packs them, and that a bucket has on average.
FLUSH_SIGNATURES = 1_500_000
BUCKET_SIGNATURES = 5_000_000
#: Distinct n-grams a byte of text, about; only sizes the buckets.
GRAMS_A_BYTE = 0.14
#: Matches that a worker makes at once, and pairs that it holds at once until repeated ones are dropped.
PAIR_CHUNK = 500_000
HELD_MATCHES = 4_000_000
#: Pairs verified in one group of documents.
BLOCK_PAIRS = 100_000
#: Sets of which a task remembers what connects them; beyond so many it starts anew.
FOREST_SETS = 200_000
#: Sets of a group within which no more pairs are sought, at least, and such sets at most; the
#: pairs of those beyond are sought like others.
LARGE, KNOWN_SETS = 64, 1_000_000
#: Entries of one signature up to which all its pairs are sought at once, when links are counted.
CROWD = 64
#: Sets and bytes of text, about, of a block of a large group; a task compares two blocks.
CROSS_SETS, CROSS_BYTES = 2048, 16 << 20
#: Segments of a group, about, and groups of a band at most.
GROUP, GROUPS = 20, 1024
#: Rounds at most, and buckets that a round has at least, about.
ROUNDS, ROUND_BUCKETS = 4, 6
#: Bits of a signature.
SIGNATURE = np.uint64((1 << 26) - 1)
#: Signatures that a worker matches at once; a bucket of more is matched in parts, by signature.
MATCH_SIGNATURES = 8_000_000
#: Times the usual signatures that a bucket of one group may have before the group is split; it
#: is matched in parts, as each set's row comes again in each bucket.
WIDE = 3

U = np.uint64
_WORD = np.array([1 if c >= 128 or chr(c).isalnum() else 0 for c in range(256)], np.int8)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_B = 0xD6E8FEB86659FD93
_BINV = pow(_B, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(b: int, n: int) -> np.ndarray:
    out = np.full(n, U(b))
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_sets(texts: pa.Array, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of each text in a row, how many each has).

    Words are maximal runs of ASCII letters, digits and non-ASCII characters of the lower-cased
    text. A text of fewer than n words has them all as its only n-gram, one without words none.
    """
    texts = pc.utf8_lower(texts.cast(pa.large_string()))
    raw = [t.as_buffer() if t.is_valid else None for t in texts]
    sizes = np.array([len(r) if r is not None else 0 for r in raw], np.int64)
    data = np.frombuffer(b"\n".join(memoryview(r) if r is not None else b"" for r in raw) + b"\n", np.uint8)
    ends = np.cumsum(sizes + 1)
    word = _WORD[data]
    edge = np.diff(word, prepend=np.int8(0))
    start, stop = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(sizes), np.int64)
    acc = np.concatenate([[U(0)], np.cumsum(_BYTE[data] * _powers(_B, len(data)), dtype=np.uint64)])
    h = mix((acc[stop] - acc[start]) * _powers(_BINV, len(data))[start])
    doc = np.searchsorted(ends, start, side="right")
    count = np.bincount(doc, minlength=len(sizes))
    last = np.cumsum(count)
    grams = h.copy()
    for k in range(1, n):
        nxt = np.zeros(len(h), np.uint64)
        nxt[: len(h) - k] = h[k:]
        inside = np.arange(len(h)) + k < last[doc]
        grams = np.where(inside, mix(grams * U(0x9E3779B97F4A7C15) + nxt), grams)
    out, per = [], np.zeros(len(sizes), np.int64)
    for i in np.nonzero(count)[0]:
        lo, hi = last[i] - count[i], last[i]
        s = grams[lo : max(hi - n + 1, lo + 1)]
        s = np.sort(s)
        s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        out.append(s)
        per[i] = len(s)
    return np.concatenate(out), per


def unit_ids(grams: np.ndarray, per: np.ndarray, seed: int = 0) -> np.ndarray:
    """A number for each set, independent for each seed; empty sets have 0."""
    out = np.zeros(len(per), np.uint64)
    has = np.nonzero(per)[0]
    if len(has):
        out[has] = mix(np.add.reduceat(mix(grams ^ U(seed)), (np.cumsum(per) - per)[has]))
    return out


CHECK = 0xA0761D6478BD642F


class Plan:
    """Bands of set sizes, each band's segments and groups of segments, for a threshold; they don't depend on the number of documents.

    Groups are numbered through all bands: those of band i are ``group[i]`` to
    ``group[i] + dealt[i] - 1``, and segment j is in the (j mod ``dealt[i]``)-th of them.
    """

    def __init__(self, threshold: Fraction, documents: int):
        t = self.threshold = Fraction(threshold)
        self.lo, self.hi, self.m = [], [], []
        lo = 1
        while lo < 1 << 31:
            hi = max(lo, int(lo / t))
            for a, v in ((self.lo, lo), (self.hi, hi), (self.m, self.segments(hi))):
                a.append(v)
            lo = hi + 1
        for a in ("lo", "hi", "m"):
            setattr(self, a, np.array(getattr(self, a), np.int64))
        self.dealt = np.clip(self.m // GROUP, 1, GROUPS)
        self.group = np.cumsum(self.dealt) - self.dealt
        self.of = np.repeat(np.arange(len(self.m)), self.dealt)
        at = np.arange(len(self.of)) - self.group[self.of]
        #: segments of each group
        self.holds = (self.m[self.of] - at + self.dealt[self.of] - 1) // self.dealt[self.of]

    def segments(self, hi: int) -> int:
        """Segments of the band up to ``hi``: what its largest pairs need, and some more, so that few sets leave out too many."""
        m = int(hi / self.threshold) * (self.threshold.denominator - self.threshold.numerator) / (self.threshold.denominator + self.threshold.numerator)
        return int(np.ceil(m + 0.5 + 0.025 * m + 3 * np.sqrt(0.025 * m)))

    def lay_out(self, lengths: list[tuple[float, int]], limit: int = BUCKET_SIGNATURES) -> int:
        """Deal the groups to buckets of about ``limit`` signatures, or up to ``WIDE`` times that for one group; returns the number of buckets.

        ``lengths``: (mean bytes, documents) of groups of texts. Sets, for each group, its first
        bucket and first block, and the parts, of a bucket and a block each, that it is split
        into; and the rounds as (first band, last band, first bucket, buckets).
        """
        volume = np.zeros(len(self.hi))
        for mean, docs in lengths:
            n = max(1.0, mean * GRAMS_A_BYTE)
            b = int(self.band(np.array([n]))[0])
            for i in (b, b - 1):
                if i >= 0:
                    volume[i] += docs * (self.m[i] + n)
        self.start, self.split = (np.ones(len(self.of), np.int64) for _ in range(2))
        count = min(ROUNDS, max(1, int(volume.sum() // (limit * ROUND_BUCKETS))))
        self.rounds = []
        at = filled = first = band = 0
        done = 0.0
        for i, v in enumerate(volume):
            v /= self.dealt[i]
            for g in range(self.group[i], self.group[i] + self.dealt[i]):
                if v <= limit:
                    if filled + v > limit:
                        at, filled = at + 1, 0
                    filled += v
                    self.start[g] = at
                else:
                    at += filled > 0
                    self.start[g] = at
                    self.split[g] = -(-v // (WIDE * limit))
                    at, filled = at + self.split[g], 0
            done += volume[i]
            last = i + 1 == len(volume)
            if last or len(self.rounds) + 1 < count and done >= volume.sum() / count * (len(self.rounds) + 1) and done < volume.sum():
                at, filled = at + (filled > 0 or at == first), 0
                self.rounds.append((band, i, int(first), int(at - first)))
                first, band = at, i + 1
        self.block = np.cumsum(self.split) - self.split
        return int(at)

    def differences(self, a, b):
        """n-grams that differ, at most, between sets of sizes a and b that reach the threshold."""
        t = self.threshold
        return (a + b) * (t.denominator - t.numerator) // (t.denominator + t.numerator)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.hi, sizes, side="left")

    def spare(self, sizes: np.ndarray, band: np.ndarray, probe: bool) -> np.ndarray:
        """Segments that a set may leave out, so that a pair keeps a match; below 0 for one that may leave out none.

        With d differences, and x and y segments left out, d + x + y is to be below 2m, whatever
        the partner; and d + 2x, where the partner leaves out none.
        """
        t, m = self.threshold, self.m[band]
        rest = (t.denominator - t.numerator) * sizes
        alone = (2 * m - 1) * (t.denominator + t.numerator) - 2 * rest
        other = self.hi[band] if probe else sizes * t.denominator // t.numerator
        return np.minimum(alone // (2 * (t.denominator + t.numerator)), (2 * m - 1 - self.differences(sizes, other)) // 2)

    def needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Matches that a pair of these sizes has at least, if it reaches the threshold, whatever its sets leave out."""
        small, large = np.minimum(a, b), np.maximum(a, b)
        i = self.band(small)
        probe = self.band(large) > i
        x = np.maximum(self.spare(small, i, False), 0)
        y = np.maximum(np.where(probe, self.spare(large, i, True), self.spare(large, i, False)), 0)
        d = self.differences(a, b)
        return self.m[i] - np.maximum(d + x + y, d + 2 * np.maximum(x, y)) // 2


def signatures(plan: Plan, grams: np.ndarray, per: np.ndarray, weight: np.ndarray | None = None, bands: tuple[int, int] | None = None, rows: list | None = None):
    """(signature, row, set, deletion?, prober?) arrays of sets in a row.

    A set has signatures in its own band, and as a prober in the band below if that may hold a
    partner; of these in ``bands`` only, if given. A row is a set's part in a group; ``rows``
    gets (set, group, segments left out there, 255 for a set that leaves out none as it has too
    many, parities) arrays of the rows. ``weight`` is not used any more.
    """
    numbered = 0
    for probe in (False, True):
        band = plan.band(np.maximum(per, 1)) - probe
        use = per > 0
        if probe:
            t = plan.threshold
            least = -(-per * t.numerator // t.denominator)
            use &= (band >= 0) & (least <= plan.hi[np.maximum(band, 0)])
        if bands is not None:
            use &= (band >= bands[0]) & (band <= bands[1])
        band = np.maximum(band, 0)
        sets = np.nonzero(use)[0]
        if not len(sets):
            continue
        g = grams if len(sets) == len(per) else grams[np.repeat(use, per)]
        size, b = per[sets], band[sets]
        m, dealt = plan.m[b], plan.dealt[b]
        base = np.cumsum(m) - m
        total = int(m.sum())
        own = np.repeat(np.arange(len(sets)), m)
        seg = np.arange(total) - base[own]
        row0 = np.cumsum(dealt) - dealt
        row = row0[own] + seg % dealt[own]
        count = int(dealt.sum())
        salt = mix((b[own].astype(np.uint64) << U(34)) + seg.astype(np.uint64) + U(1))
        hashed = mix(g + U(0x632BE59BD9B4E019))
        of = np.repeat(np.arange(len(sets)), size)
        slot = base[of] + ((hashed >> U(33)).astype(np.int64) * m[of] >> 31)
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, slot, hashed)
        few = np.bincount(slot, minlength=total) <= 1
        over = np.bincount(own, few, len(sets)) > plan.spare(size, b, probe)
        few &= ~over[own]
        at = np.nonzero(~few)[0]
        if rows is not None:
            of_row = np.repeat(np.arange(len(sets)), dealt)
            left = np.where(over[of_row], 255, np.bincount(row, few, count)).astype(np.uint8)
            odd = np.bincount(row[slot] << 7 | (hashed & U(127)).astype(np.int64), minlength=count << 7) & 1
            maps = np.packbits(odd.astype(np.uint8)).view(np.uint64).reshape(count, 2)
            rows.append((sets[of_row], plan.group[b][of_row] + np.arange(count) - row0[of_row], left, maps))
        yield mix(sums[at] + salt[at]), row[at] + numbered, sets[own[at]], False, probe
        drop = ~few[slot]
        s = slot[drop]
        yield mix(sums[s] - hashed[drop] + salt[s]), row[s] + numbered, sets[of[drop]], True, probe
        numbered += count


_HEAD = np.dtype([("kind", "<u4"), ("docs", "<u4"), ("entries", "<u4"), ("jumps", "<u4")])


def pack(sig: np.ndarray, who: np.ndarray, units: np.ndarray, sizes: np.ndarray, left: np.ndarray | None = None, maps: np.ndarray | None = None, group: int = 0) -> bytes:
    """Signatures of one group and bucket: sorted, and 16 bits each for their set and flags.

    ``who``: local set << 2 | deletion << 1 | prober, below 2**16. The upper halves of the
    signatures go as differences of a byte, which compress, with the few larger ones apart.
    ``left`` and ``maps`` are what each set leaves out, and its parities.
    """
    order = np.argsort(sig)
    sig, who = sig[order], who[order]
    ids, local = np.unique(who >> 2, return_inverse=True)
    step = np.diff(sig >> np.uint32(16), prepend=np.uint32(0))
    jumps = step[step > 254]
    head = np.array([(group << 1, len(ids), len(sig), len(jumps))], _HEAD)
    who = local.astype(np.uint16) << 2 | (who & 3).astype(np.uint16)
    parts = (units[ids].astype("<u8"), sizes[ids].astype("<u4"), jumps.astype("<u4"), np.minimum(step, 255).astype(np.uint8), sig.astype("<u2"), (who & 255).astype(np.uint8), (who >> 8).astype(np.uint8))
    if left is not None:
        parts += (left[ids], maps[ids].astype("<u8"))
    return zstandard.compress(b"".join([head.tobytes(), *(x.tobytes() for x in parts)]), 1)


def pack_members(units: np.ndarray, ids: np.ndarray, checks: np.ndarray) -> bytes:
    return zstandard.compress(np.array([(1, len(units), 0, 0)], _HEAD).tobytes() + units.astype("<u8").tobytes() + ids.astype("<i8").tobytes() + checks.astype("<u8").tobytes(), 1)


def unpack(blob: bytes):
    """(kind, units, sizes, signatures, local set and flags), or (1, units, ids, checks, None); the kind of signatures is twice their group."""
    return _unpack(blob)[:5]


def _unpack(blob: bytes):
    """As ``unpack``, and what the sets leave out, and their parities."""
    blob = zstandard.decompress(blob)
    kind, docs, n, jumps = (int(x) for x in np.frombuffer(blob, _HEAD, 1)[0])
    at = _HEAD.itemsize

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += out.nbytes
        return out

    units = take("<u8", docs)
    if kind == 1:
        return kind, units, take("<i8", docs), take("<u8", docs), None, None, None
    sizes, big, step = take("<u4", docs), take("<u4", jumps), take("u1", n).astype(np.uint32)
    step[step == 255] = big
    sig = np.cumsum(step, dtype=np.uint32) << np.uint32(16) | take("<u2", n)
    who = take("u1", n) | take("u1", n).astype(np.uint16) << np.uint16(8)
    extra = (take("u1", docs), take("<u8", 2 * docs).reshape(docs, 2)) if at < len(blob) else (None, None)
    return kind, units, sizes, sig, who, *extra


def _sign(plan: Plan, turn: int, n: int):
    """Texts to (bucket, block) rows of one round; members go with the first."""
    low, high, start, buckets = plan.rounds[turn]

    def flush(got: list[tuple]) -> Iterator[pa.RecordBatch]:
        grams, per, ids = (np.concatenate(x) for x in zip(*got))
        units = unit_ids(grams, per)
        # sets that occur twice in the batch are signed once
        _, first = np.unique(units, return_index=True)
        once = np.zeros(len(units), bool)
        once[first] = True
        once &= per > 0
        g, p, u = grams[np.repeat(once, per)], per[once], units[once]
        out = []
        parts, rows = [], []
        for s, row, _, dele, probe in signatures(plan, g, p, bands=(low, high), rows=rows):
            parts.append(((s & SIGNATURE).astype(np.uint32), (s >> U(40)).astype(np.uint32), row.astype(np.uint32), np.full(len(s), 2 * dele + probe, np.uint8)))
        if parts:
            of, group, left, maps = (np.concatenate(x) for x in zip(*rows))
            sig, part, row, flags = (np.concatenate(x) for x in zip(*parts))
            del parts, rows
            part = part.astype(np.int64) * plan.split[group][row] >> 24
            block = plan.block[group][row] + part
            order = np.argsort(block, kind="stable")
            edge = np.concatenate([[0], np.nonzero(np.diff(block[order]))[0] + 1, [len(order)]])
            for a, b in zip(edge[:-1], edge[1:]):
                mine = order[a:b]
                here, local = np.unique(row[mine], return_inverse=True)
                k = int(group[here[0]])
                who = local.astype(np.uint32) << np.uint32(2) | flags[mine]
                out.append((int(plan.start[k] + part[mine[0]] - start), pack(sig[mine], who, u[of[here]], p[of[here]], left[here], maps[here], k)))
        if not turn:
            checks = unit_ids(grams, per, CHECK)
            named = per > 0
            home = (units[named] >> U(32)) * U(buckets) >> U(32)
            for i in np.unique(home):
                mine = np.nonzero(named)[0][home == i]
                out.append((int(i), pack_members(units[mine], ids[mine], checks[mine])))
        for at in range(0, len(out), 16):
            b, data = zip(*out[at : at + 16])
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size, docs = [], 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                grams, per = gram_sets(b.column(1), n)
                ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                if turn:
                    band = plan.band(np.maximum(per, 1))
                    mine = (per > 0) & (band >= low) & (band <= high + 1)
                    grams, per, ids = grams[np.repeat(mine, per)], per[mine], ids[mine]
                got.append((grams, per, ids))
                size += 2.5 * len(grams)
                docs += len(per)
                if size >= FLUSH_SIGNATURES or docs >= 1 << 13:
                    yield from flush(got)
                    got, size, docs = [], 0, 0
        if docs:
            yield from flush(got)

    return run


def _match(plan: Plan, star: bool = False, known: tuple[np.ndarray, np.ndarray] | None = None, crowd: int | None = None):
    """Blocks of a bucket to (a, b, need, t): pairs of units a and b, with 0 and 0; members come as (unit, id, -1, check).

    With ``star``, the sets of a signature are paired with the first and the next of them only.
    With ``crowd``, so are those of a signature of more than so many entries, of which the first
    is paired with subsets only, and with one deletion; all these sets come as (unit, 0, -2, 0).
    With ``known``, (sorted units, group of each), pairs within a group are left out.
    """

    def rows(a, b, need, t):
        cols = [pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(need.astype(np.int32)), pa.array(t.astype(np.int64))]
        whole = pa.RecordBatch.from_arrays(cols, names=["a", "b", "need", "t"])
        for at in range(0, whole.num_rows, 1 << 18):
            yield whole.slice(at, 1 << 18)

    def gathered(blobs: list[bytes], part: int, parts: int):
        """(keys, units, sizes, groups, left out, parities): the signatures of one part of their range, with their sets numbered."""
        keys, sets, base = [], [], 0
        for i, blob in enumerate(blobs):
            if part + 1 == parts:
                blobs[i] = b""
            kind, u, s, sig, who, left, maps = _unpack(blob)
            if parts > 1:
                mine = ((sig & np.uint32(SIGNATURE)).astype(np.uint64) * U(parts) // (SIGNATURE + U(1))).astype(np.int64) == part
                sig, (ids, local), flags = sig[mine], np.unique(who[mine] >> 2, return_inverse=True), who[mine] & 3
                u, s, left, maps, who = u[ids], s[ids], left[ids], maps[ids], local.astype(np.uint64) << U(2) | flags
            # signature, deletion, set, prober: subsets come before deletions in a group
            key = sig.astype(np.uint64) << U(32)
            key |= (who.astype(np.uint64) >> U(1) & U(1)) << U(31) | (who & 1)
            key |= ((who >> 2).astype(np.uint64) + U(base)) << U(1)
            keys.append(key)
            sets.append((u, s, np.full(len(u), kind >> 1, np.int32), left, maps))
            base += len(u)
        return np.concatenate(keys), *(np.concatenate(x) for x in zip(*sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, entries, sets = [], 0, 0
        for batch in batches:
            for blob in batch.column(1):
                data = blob.as_buffer()
                kind, docs, n, _ = (int(x) for x in np.frombuffer(zstandard.ZstdDecompressor().stream_reader(data).read(_HEAD.itemsize), _HEAD, 1)[0])
                if kind == 1:
                    _, u, ids, checks, _ = unpack(data)
                    yield from rows(u, ids, np.full(len(u), -1), checks)
                    continue
                blobs.append(data.to_pybytes())
                entries, sets = entries + n, sets + docs
        parts = max(1, -(-entries // MATCH_SIGNATURES))
        while blobs and sets > parts * (1 << 29) and parts < 1 << 16:
            parts *= 2
        for part in range(parts if blobs else 0):
            yield from matched(*gathered(blobs, part, parts))

    def matched(key: np.ndarray, units: np.ndarray, sizes: np.ndarray, groups: np.ndarray, left_out: np.ndarray, maps: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, at, inverse = np.unique(units ^ mix(groups.astype(np.uint64)), return_index=True, return_inverse=True)
        label = np.zeros(len(at), np.int64)
        if known is not None and len(known[0]):
            place = np.minimum(np.searchsorted(known[0], units[at]), len(known[0]) - 1)
            label = np.where(known[0][place] == units[at], known[1][place] + 1, 0)
        if star or crowd or known is not None:
            # in the same order in every group, and those of one label together
            order = np.lexsort((units[at], label))
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            at, label, inverse = at[order], label[order], rank[inverse]
        every, size, group, maps = units[at], sizes[at].astype(np.int64), groups[at], maps[at]
        # segments left out, and how often those of a partner count
        whole = left_out[at] == 255
        left_out, counts, most = np.where(whole, 0, left_out[at]).astype(np.int64), whole + 1, 2 * plan.holds[group] - 1
        # sets are numbered by block so far; one that came in several blocks gets one number
        mask = U((1 << 30) - 1)
        to = inverse.astype(np.uint64) << U(1)
        del units, sizes, groups, inverse
        trim()
        for at in range(0, len(key), 1 << 20):
            part = key[at : at + (1 << 20)]
            part[:] = part & ~(mask << U(1)) | to[(part >> U(1) & mask).astype(np.int64)]
        key.sort()
        sig = (key >> U(32)).astype(np.uint32)
        same = sig[1:] == sig[:-1]
        keep = np.zeros(len(key), bool)
        keep[1:] |= same
        keep[:-1] |= same
        key = key[keep]
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        sig = (key >> U(32)).astype(np.uint32)
        if not len(key):
            return
        head = np.nonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))[0]
        length = np.diff(np.append(head, len(key)))
        left = np.repeat(head + length, length) - np.arange(len(key)) - 1
        first = np.nonzero((key >> U(31) & U(1) == 0) & (left > 0))[0]
        left, after = left[first], first + 1
        if star:
            left = np.where(np.isin(first, head, assume_unique=True), left, 1)
        elif crowd:
            size_of, subsets = np.repeat(length, length)[first], np.repeat(np.add.reduceat((key >> U(31) & U(1) == 0).astype(np.int64), head), length)
            fewer = size_of > crowd
            if fewer.any():
                crowded = np.unique((key[np.repeat((length > crowd) & (subsets[head] > 0), length)] >> U(1) & mask).astype(np.int64))
                units = np.unique(every[crowded]).astype(np.int64)
                none = np.zeros(len(units), np.int64)
                yield from rows(units, none, none - 2, none)
                left = np.where(~fewer, left, np.where(np.isin(first, head, assume_unique=True), np.minimum(left, subsets[first]), 1))
        elif known is not None:
            # partners are the later subsets of other labels, and the deletions below and above the own label
            own = np.where(label == 0, np.arange(len(label)), np.searchsorted(label, label)).astype(np.uint64)
            of = key & ~(mask << U(1) | U(1)) | own[(key >> U(1) & mask).astype(np.int64)] << U(1)
            mine = of[first] | U(1 << 31)
            edges = [np.searchsorted(of, of[first], "right"), np.searchsorted(of, mine >> U(31) << U(31)), np.searchsorted(of, mine), np.searchsorted(of, mine, "right"), after + left]
            after = np.concatenate([edges[0], edges[1], edges[3]])
            left = np.concatenate([edges[1] - edges[0], edges[2] - edges[1], edges[4] - edges[3]])
            first = np.tile(first, 3)[left > 0]
            after, left = after[left > 0], left[left > 0]
        cum = np.cumsum(left)
        held, filled, at = [], 0, 0
        while at < len(first):
            done = cum[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(cum, done + PAIR_CHUNK, side="right")))
            f, n = first[at:to], left[at:to]
            before = np.cumsum(n) - n
            x, y = key[np.repeat(f, n)], key[np.arange(int(n.sum())) + np.repeat(after[at:to] - before, n)]
            at = to
            p, q = (x >> U(1) & mask).astype(np.int64), (y >> U(1) & mask).astype(np.int64)
            ok = ((x & y & U(1)) == 0) & (group[p] == group[q]) & (p != q)
            p, q = p[ok], q[ok]
            near = self_ok(plan, size, p, q)
            p, q = p[near], q[near]
            bits = np.bitwise_count(maps[p] ^ maps[q]).sum(axis=1, dtype=np.int64)
            near = bits <= most[p] - left_out[p] * counts[q] - left_out[q] * counts[p]
            p, q = p[near], q[near]
            held.append(np.unique(np.minimum(p, q) << 32 | np.maximum(p, q)))
            filled += len(held[-1])
            if filled > HELD_MATCHES or at >= len(first):
                pairs = np.unique(np.concatenate(held))
                if at < len(first) and len(pairs) <= HELD_MATCHES // 2:
                    held, filled = [pairs], len(pairs)
                    continue
                held, filled = [], 0
                for i in range(0, len(pairs), PAIR_CHUNK):
                    p, q = pairs[i : i + PAIR_CHUNK] >> 32, pairs[i : i + PAIR_CHUNK] & 0xFFFFFFFF
                    a, b = every[p].astype(np.int64), every[q].astype(np.int64)
                    none = np.zeros(len(p), np.int64)
                    yield from rows(np.minimum(a, b), np.maximum(a, b), none, none)

    return run


def self_ok(plan: Plan, size: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Pairs whose sizes allow the threshold at all."""
    a, b = size[p.astype(np.int64)], size[q.astype(np.int64)]
    t = plan.threshold
    return np.minimum(a, b) * t.denominator >= np.maximum(a, b) * t.numerator


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    i = F.col(f"`{id_col}`")
    i = i.try_cast("bigint") if isinstance(docs.schema[id_col].dataType, T.StringType) else i.cast("bigint")
    return docs.select(i.alias("id"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")


def candidates(docs: DataFrame, plan: Plan, n: int = NGRAM, star: bool = False, known: tuple[np.ndarray, np.ndarray] | None = None, crowd: int | None = None) -> DataFrame:
    """(a, b, need, t): pairs of units that some group passes on, with 0 and 0, and (unit, id, -1, check) of every document.

    With ``crowd``, also (unit, 0, -2, 0) of sets that ``_match`` left pairs of out.

    Each round is written by itself, and its shuffle files are deleted at its end. Bands of
    different rounds have no pair in common, so no row comes twice.
    """
    out = None
    for turn, (low, _, _, buckets) in enumerate(plan.rounds):
        # a text of w words has 2w - 1 bytes at least, and no more n-grams than words
        texts = docs.where(F.octet_length("text") >= int(2 * plan.lo[low] - 1)) if turn else docs
        signed = map_arrow(spread(texts), _sign(plan, turn, n), "bucket int, block binary").repartitionById(buckets, "bucket")
        rows = map_arrow(signed, _match(plan, star, known, crowd), "a bigint, b bigint, need int, t bigint").distinct()
        found, _ = written(rows, "candidates")
        out = found if out is None else out.union(found)
    return out


def _packed_sets(n: int):
    """(id, text, blocks) to (block, unit, check, grams) rows, 8 bytes an n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                grams, per = gram_sets(b.column(1), n)
                units, checks = unit_ids(grams, per).astype(np.int64), unit_ids(grams, per, CHECK).astype(np.int64)
                edge = np.concatenate([[0], np.cumsum(per)])
                out = []
                for i, wanted in enumerate(b.column(2).to_pylist()):
                    mine = [w["block"] for w in wanted if w["unit"] == units[i] and w["check"] == checks[i]]
                    if mine:
                        data = grams[edge[i] : edge[i + 1]].astype("<u8").tobytes()
                        out += [(x, int(units[i]), None, int(checks[i]), data) for x in mine]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (*[pa.int64()] * 4, pa.binary()))], names=["block", "a", "b", "check", "grams"])

    return run


def _verify(threshold: Fraction):
    """Rows sorted by block, sets first, to (a, a_check, b, b_check, jaccard) of the pairs that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets = None, {}
        for b in batches:
            out = []
            for x, a, c, check, data in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4)):
                if x != block:
                    block, sets = x, {}
                if c is None:
                    sets.setdefault(a, {})[check] = np.frombuffer(data.as_py(), "<u8")
                    continue
                for (ac, s), (bc, t) in product(sets[a].items(), sets[c].items()):
                    both = np.concatenate([s, t])
                    both.sort()
                    inter = int((both[1:] == both[:-1]).sum())
                    union = len(s) + len(t) - inter
                    if inter * threshold.denominator >= union * threshold.numerator:
                        out.append((a, ac, c, bc, inter / union))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (*[pa.int64()] * 4, pa.float64()))], names=["a", "a_check", "b", "b_check", "jaccard"])

    return run


def unit_pairs(docs: DataFrame, n: int = NGRAM, threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", star: bool = False, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, a_check, b, b_check, jaccard) of sets, members (unit, check, id)); both written in the shared folder.

    A set goes by its two sums; every (unit, check, id) is there once. ``star`` and ``known``
    leave out pairs as in ``_match``.
    """
    return _unit_pairs(_documents(docs, id_col, text_col), n, threshold, star, known)[:2]


def _unit_pairs(d: DataFrame, n: int, threshold: Fraction, star: bool = False, known: tuple[np.ndarray, np.ndarray] | None = None, crowd: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``unit_pairs`` of (id, text) rows, and the units (unit) of sets that ``crowd`` left pairs of out."""
    by = d.select(F.octet_length("text").alias("n")).groupBy(F.floor(F.log2(F.col("n") + 1) * 4).alias("g"))
    lengths = [(r["mean"], r["docs"]) for r in by.agg(F.avg("n").alias("mean"), F.count(F.lit(1)).alias("docs")).collect()]
    plan = Plan(threshold, sum(c for _, c in lengths))
    plan.lay_out(lengths)
    found = candidates(d, plan, n, star, known, crowd)
    pairs = found.where("need >= 0").select("a", "b")
    members = found.where("need = -1").select(F.col("a").alias("unit"), F.col("t").alias("check"), F.col("b").alias("id"))
    left_out = found.where("need = -2").select(F.col("a").alias("unit")).distinct()

    # A pair is verified in the block of its first unit's least neighbour, so that sets of a
    # cluster travel once; a block of many pairs is cut by the first unit.
    ends = pairs.union(pairs.select("b", "a")).toDF("v", "w")
    hubs = ends.groupBy("v").agg(F.least(F.min("v"), F.min("w")).alias("hub"))
    placed = pairs.distinct().join(hubs, pairs["a"] == hubs["v"]).select("a", "b", "hub")
    cuts = placed.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_PAIRS)).cast("bigint").alias("cuts"))
    placed = placed.join(cuts, "hub").select("a", "b", F.xxhash64("hub", F.pmod(F.xxhash64("a"), F.col("cuts"))).alias("block"))
    placed, _ = written(placed, "placed")
    wanted = placed.select("block", F.col("a").alias("unit")).union(placed.select("block", F.col("b").alias("unit"))).distinct()
    one = members.groupBy("unit", "check").agg(F.min("id").alias("id"))
    wanted = wanted.join(one, "unit").groupBy("id").agg(F.collect_list(F.struct("block", "unit", "check")).alias("blocks"))
    wanted, wanted_size = written(wanted, "wanted")
    texts = d.join(small(wanted, wanted_size), "id").select("id", "text", "blocks")
    sets = map_arrow(texts, _packed_sets(n), "block bigint, a bigint, b bigint, check bigint, grams binary")
    none = F.lit(None).cast("bigint")
    rows = sets.union(placed.select("block", "a", "b", none.alias("check"), F.lit(None).cast("binary").alias("grams")))
    rows = rows.repartition("block").sortWithinPartitions("block", F.col("b").asc_nulls_first())
    done, _ = written(map_arrow(rows, _verify(Fraction(threshold)), "a bigint, a_check bigint, b bigint, b_check bigint, jaccard double"), "pairs")
    return done, members, left_out


def _side(sets: DataFrame, of: str, *cols: str) -> DataFrame:
    """``sets`` with keys and columns named after one side of a pair."""
    return sets.select(F.col("unit").alias(of), F.col("check").alias(f"{of}_check"), *[F.col(c).alias(f"{of}_{c}") for c in cols])


def ngram_jaccard_join(docs: DataFrame, n: int = NGRAM, threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(left_ids, right_ids, jaccard): every pair of documents of Jaccard similarity ``threshold`` or more, in product form.

    Each row stands for all pairs of a left with a right id. Documents of one n-gram set are
    listed together, so k copies cost k ids a row and not k * k pairs; such a list is given
    once against itself, its least id on the left, at 1.0, and its members are as similar to
    each other. No pair is missed and none is capped. Ids are whole numbers, or their text;
    rows of any other id or a null text, and texts without words, are in no pair. A repeated row
    counts once; two texts of one id may be a pair. Lists are sorted; other columns are
    ignored; an empty table gives no rows; a text of any length is read whole.
    """
    pairs, members = unit_pairs(docs, n, threshold, id_col, text_col)
    lists = members.groupBy("unit", "check").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    first = F.col("a_ids")[0] < F.col("b_ids")[0]
    across = pairs.join(_side(lists, "a", "ids"), ["a", "a_check"]).join(_side(lists, "b", "ids"), ["b", "b_check"])
    across = across.select(F.when(first, F.col("a_ids")).otherwise(F.col("b_ids")).alias("left_ids"), F.when(first, F.col("b_ids")).otherwise(F.col("a_ids")).alias("right_ids"), "jaccard")
    within = lists.where(F.size("ids") > 1).select(F.slice("ids", 1, 1).alias("left_ids"), F.expr("slice(ids, 2, size(ids) - 1)").alias("right_ids"), F.lit(1.0).alias("jaccard"))
    return across.unionByName(within)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets less those whose two sets are connected by pairs before them in the same task."""
    parent: dict[tuple[int, int], tuple[int, int]] = {}

    def root(v: tuple[int, int]) -> tuple[int, int]:
        parent.setdefault(v, v)
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for batch in batches:
        a, a_check, b, b_check = (c.to_pylist() for c in batch.columns)
        kept = []
        for i, (u, v) in enumerate(zip(zip(a, a_check), zip(b, b_check))):
            u, v = root(u), root(v)
            if u != v:
                parent[u] = v
                kept.append(i)
        yield batch.take(pa.array(kept, pa.int64()))
        if len(parent) > FOREST_SETS:
            parent.clear()


def _grouped(pairs: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets (unit, check, low, n), labels (v, root)): each set's least id and number of ids, and the group of each least id.

    Groups are found among sets, of which each goes by its least id, so that copies add no
    edges; of the pairs that a task reads only a spanning forest is shuffled. Sets that share an
    id belong together, as the id is one document.
    """
    pairs = map_arrow(pairs.select("a", "a_check", "b", "b_check"), _forest, "a bigint, a_check bigint, b bigint, b_check bigint")
    sets, _ = written(members.groupBy("unit", "check").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "sets")
    near = pairs.join(_side(sets, "a", "low"), ["a", "a_check"]).join(_side(sets, "b", "low"), ["b", "b_check"]).select(F.col("a_low").alias("a"), F.col("b_low").alias("b"))
    # an id of several texts is in several sets; most tables have none
    several = members.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id")
    shared = members.join(several, "id").join(sets, ["unit", "check"]).select("id", "low")
    star = shared.select(F.col("id").alias("a"), F.col("low").alias("b"))
    return sets, components(near.union(star).where("a <> b"))


def near_duplicate_classes(docs: DataFrame, n: int = NGRAM, threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) of each document that is similar to another by ``ngram_jaccard_join``.

    ``class_id`` is the least id of the group that links connect, and ``n_links`` the number of
    documents that reach the threshold with this one, copies included; copies are counted and
    not expanded, so a document is one row whatever its number of links. A repeated row counts
    once. An id of several texts has the links of them all, summed, and groups them. Ids that
    aren't whole numbers, null texts and texts without words are in no row; an empty table gives
    none; other columns are ignored.

    The pairs of a large group grow with the square of its sets, so they are counted and none is
    written: where many sets share a signature few of its pairs are sought at first, which find
    the large groups; then all other pairs of those sets are, but for pairs within one of these
    groups, whose sets are compared with each other by blocks (``_links_within``).
    """
    d = _documents(docs, id_col, text_col)
    pairs, members, crowded = _unit_pairs(d, n, threshold, crowd=CROWD)
    within = None
    if crowded.limit(1).count():
        sets, labels = _grouped(pairs, members)
        large, arrays = _large_groups(sets, labels)
        ids = members.join(crowded, "unit").groupBy("unit", "check").agg(F.min("id").alias("id")).select("id").distinct()
        ids, size = written(ids, "crowded")
        more, _, _ = _unit_pairs(d.join(small(ids, size), "id", "left_semi"), n, threshold, known=arrays)
        pairs = pairs.union(more).distinct()
        if large is not None:
            sets, _ = written(sets, "sets")
            within = _links_within(d, large, sets, n, Fraction(threshold))
    sets, labels = _grouped(pairs, members)
    if within is not None:
        # pairs within a large group connect it, and are counted with all the others there
        for side in ("a", "b"):
            pairs = pairs.join(large.select(F.col("unit").alias(side), F.col("root").alias(f"{side}_root")), side, "left")
        pairs = pairs.where("a_root IS NULL OR b_root IS NULL OR a_root <> b_root").drop("a_root", "b_root")
    flipped = pairs.select(F.col("b").alias("a"), F.col("b_check").alias("a_check"), F.col("a").alias("b"), F.col("a_check").alias("b_check"))
    both = pairs.drop("jaccard").unionByName(flipped)
    links = both.join(_side(sets, "b", "n"), ["b", "b_check"]).groupBy(F.col("a").alias("unit"), F.col("a_check").alias("check")).agg(F.sum("b_n").alias("links"))
    if within is not None:
        links = links.unionByName(within).groupBy("unit", "check").agg(F.sum("links").alias("links"))
    per = sets.join(links, ["unit", "check"], "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("n") - 1).where("links > 0")
    per = per.join(labels, per["low"] == labels["v"], "left").select("unit", "check", F.coalesce("root", "low").alias("class_id"), "links")
    per, size = written(per, "linked")
    rows = members.join(small(per, size), ["unit", "check"])
    return rows.groupBy(F.col("id").alias("doc_id")).agg(F.min("class_id").alias("class_id"), F.sum("links").alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the least number of each vertex's connected component in ``edges`` (a, b).

    Labels spread to neighbours and then jump to their label's label, so that rounds grow with
    the logarithm of a component's width; every round is a written table of two numbers a row.
    """
    both, _ = written(edges.select("a", "b").union(edges.select("b", "a")).toDF("v", "w").distinct(), "edges")
    labels, _ = written(both.groupBy("v").agg(F.least(F.min("v"), F.min("w")).alias("root")), "labels")
    while True:
        near = both.join(labels.toDF("w", "l"), "w").groupBy("v").agg(F.min("l").alias("l"))
        spread = labels.join(near, "v").select("v", F.least("root", "l").alias("r"), F.col("root").alias("old"))
        spread, _ = written(spread, "spread")
        jump = spread.select(F.col("v").alias("r"), F.col("r").alias("rr"))
        new, _ = written(spread.join(jump, "r").select("v", F.least("r", "rr").alias("root"), (F.least("r", "rr") < F.col("old")).alias("changed")), "labels")
        labels = new.select("v", "root")
        if not new.where("changed").limit(1).count():
            return labels


def _large_groups(sets: DataFrame, labels: DataFrame) -> tuple[DataFrame | None, tuple[np.ndarray, np.ndarray]]:
    """Written (unit, root) of groups of ``LARGE`` sets or more, None without any, and (sorted units, group of each); of the largest, where that is more than ``KNOWN_SETS``."""
    of = sets.join(labels, sets["low"] == labels["v"]).select("unit", "root")
    counts = of.groupBy("root").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= LARGE)
    least, total = None, 0
    for r in sorted(counts.groupBy("k").agg(F.sum("k").alias("sets")).collect(), reverse=True):
        total += r["sets"]
        if total > KNOWN_SETS:
            break
        least = r["k"]
    if least is None:
        return None, (np.empty(0, np.uint64), np.empty(0, np.int64))
    # a sum that two sets share says nothing of either
    once = sets.groupBy("unit").agg(F.count(F.lit(1)).alias("c")).where("c = 1").select("unit")
    large, _ = written(of.join(counts.where(F.col("k") >= least).select("root"), "root").join(once, "unit").select("unit", "root"), "large")
    got = large.toArrow()
    units = got.column("unit").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(units)
    return large, (units[order], np.unique(got.column("root").to_numpy(), return_inverse=True)[1][order].astype(np.int64))


def _block_sets(n: int):
    """(id, text, unit, check, n, tasks) to (task, side, unit, check, n, grams) rows of the text's own set, one a task and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                grams, per = gram_sets(b.column(1), n)
                units, checks = unit_ids(grams, per).astype(np.int64), unit_ids(grams, per, CHECK).astype(np.int64)
                edge = np.concatenate([[0], np.cumsum(per)])
                out = []
                for i, (unit, check, copies, tasks) in enumerate(zip(*(b.column(k).to_pylist() for k in range(2, 6)))):
                    if unit == units[i] and check == checks[i]:
                        data = grams[edge[i] : edge[i + 1]].astype("<u8").tobytes()
                        out += [(t["task"], t["side"], unit, check, copies, data) for t in tasks]
                for k in range(0, len(out), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out[k : k + 1024]), (pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.binary()))], names=["task", "side", "unit", "check", "n", "grams"])

    return run


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set of ``a`` shares with each of ``b``: common ones by matrix products, rare ones one by one."""
    out = np.zeros((len(a), len(b)), np.float32)
    sides, found = [], []
    for x in (a, b):
        g, who = np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])
        order = np.argsort(g, kind="stable")
        sides.append((g[order], who[order]))
        found.append(np.unique(g[order], return_index=True, return_counts=True))
    _, i, j = np.intersect1d(found[0][0], found[1][0], assume_unique=True, return_indices=True)
    (at, k), (to, m) = ((f[1][x], f[2][x]) for f, x in zip(found, (i, j)))
    common = k * m > max(1, out.size // 128)
    for lo in range(0, int(common.sum()), 512):
        cols = np.nonzero(common)[0][lo : lo + 512]
        dense = []
        for (_, who), start, count in ((sides[0], at, k), (sides[1], to, m)):
            c = np.repeat(np.arange(len(cols)), count[cols])
            place = np.arange(len(c)) - np.repeat(np.cumsum(count[cols]) - count[cols], count[cols]) + np.repeat(start[cols], count[cols])
            d = np.zeros((len(a) if start is at else len(b), len(cols)), np.float32)
            d[who[place], c] = 1
            dense.append(d)
        out += dense[0] @ dense[1].T
    rare = np.nonzero(~common)[0]
    product_ = np.cumsum(k[rare] * m[rare])
    lo = 0
    while lo < len(rare):
        hi = max(lo + 1, int(np.searchsorted(product_, (product_[lo - 1] if lo else 0) + PAIR_CHUNK, side="right")))
        c = rare[lo:hi]
        lo = hi
        size = k[c] * m[c]
        of = np.repeat(np.arange(len(c)), size)
        place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        p, q = sides[0][1][at[c][of] + place // m[c][of]], sides[1][1][to[c][of] + place % m[c][of]]
        cell, times = np.unique(p * len(b) + q, return_counts=True)
        out.reshape(-1)[cell] += times
    return out


def _count_within(threshold: Fraction):
    """Rows sorted by task and side to (unit, check, links): documents of the other sets of the task that reach the threshold."""

    def links(sets: list[list]) -> Iterator[pa.RecordBatch]:
        own, left, right = sets
        for one, other in ((own, own), (left, right)):
            if not one or not other:
                continue
            shared = shared_counts([x[3] for x in one], [x[3] for x in other]).astype(np.int64)
            a, b = (np.array([len(x[3]) for x in side], np.int64) for side in (one, other))
            near = shared * (threshold.denominator + threshold.numerator) >= (a[:, None] + b[None]) * threshold.numerator
            if one is other:
                np.fill_diagonal(near, False)
            n, m = (np.array([x[2] for x in side], np.int64) for side in (one, other))
            for side, got in ((one, near @ m), (other, n @ near)):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in side], pa.int64()), pa.array([x[1] for x in side], pa.int64()), pa.array(got, pa.int64())], names=["unit", "check", "links"])
                if one is other:
                    break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, sets = None, None, [[], [], []]
        for b in batches:
            for x, side, unit, check, copies, data in zip(*(b.column(i).to_pylist() for i in range(6))):
                if x != task:
                    yield from links(sets)
                    task, last, sets = x, None, [[], [], []]
                if (side, unit) != last:  # rows of one id may repeat its text
                    last = side, unit
                    sets[side].append((unit, check, copies, np.frombuffer(data, "<u8")))
        yield from links(sets)

    return run


def _links_within(d: DataFrame, large: DataFrame, sets: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """(unit, check, links): of each set of ``large`` (unit, root), the documents of other sets of its group that reach the threshold.

    A group is cut into blocks of about ``CROSS_SETS`` sets or ``CROSS_BYTES`` of text, and a
    task compares two blocks, so that what it holds doesn't grow with the group.
    """
    spark = d.sparkSession
    of = large.join(sets, "unit").select("unit", "check", "n", "low", "root")
    bytes_ = d.select(F.col("id").alias("low"), F.octet_length("text").alias("b")).groupBy("low").agg(F.max("b").alias("b"))
    of, _ = written(of.join(bytes_, "low"), "within")
    cuts = of.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(CROSS_SETS)), F.ceil(F.sum("b") / F.lit(CROSS_BYTES))).cast("int").alias("cuts"))
    of = of.join(cuts, "root").withColumn("i", F.pmod(F.xxhash64("unit"), F.col("cuts")).cast("int"))
    # block i is alone in a task (0), on the left (1) of one with each later block, and on the right (2) of one with each earlier
    tasks = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.struct(F.xxhash64("root", F.least("i", j), F.greatest("i", j)).alias("task"), F.when(j == F.col("i"), 0).when(j > F.col("i"), 1).otherwise(2).alias("side")))
    of, size = written(of.select(F.col("low").alias("id"), "unit", "check", "n", tasks.alias("tasks")), "blocks")
    texts = d.join(small(of, size), "id").select("id", "text", "unit", "check", "n", "tasks")
    rows = map_arrow(texts, _block_sets(n), "task bigint, side int, unit bigint, check bigint, n bigint, grams binary")
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism, "task").sortWithinPartitions("task", "side", "unit")
    done, _ = written(map_arrow(rows, _count_within(threshold), "unit bigint, check bigint, links bigint"), "links")
    return done


def drop_near_duplicates(docs: DataFrame, n: int = NGRAM, threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less all but one document of each group connected by pairs of ``ngram_jaccard_join``.

    The least id of a group stays. Rows of one id are one document and stay or go together;
    rows without a whole-number id, of a null text or of a text without words stay. All columns
    are kept, whatever their names; an empty table stays empty.

    Pairs within a large group grow with the square of its sets, and only tell what some of them
    tell. So groups are first found by pairs in stars, and then all pairs but those within the
    large groups found so far are sought, so that no link between groups is missed.
    """
    pairs, members = unit_pairs(docs, n, threshold, id_col, text_col, star=True)
    _, known = _large_groups(*_grouped(pairs, members))
    more, _ = unit_pairs(docs, n, threshold, id_col, text_col, known=known)
    sets, labels = _grouped(pairs.unionByName(more), members)
    roots = sets.join(labels, sets["low"] == labels["v"], "left").select("unit", "check", F.coalesce("root", "low").alias("root"), "n", "low")
    # only sets of copies, and sets whose group has a lesser id, have anything to drop
    roots, size = written(roots.where("n > 1 OR root <> low"), "roots")
    losers = members.join(small(roots, size), ["unit", "check"]).where("id <> root").select(F.col("id").alias("_tsr_near_id"))
    losers, size = written(losers.distinct(), "losers")
    i = F.col(f"`{id_col}`")
    i = i.try_cast("bigint") if isinstance(docs.schema[id_col].dataType, T.StringType) else i.cast("bigint")
    return docs.join(small(losers, size), i == F.col("_tsr_near_id"), "left_anti")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE nw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
ng AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS g FROM nw WHERE len(w) > 0),
nt AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min(doc_id), g) AS k, list_sort(list_distinct(list(doc_id))) AS ids, len(g) AS n, g FROM ng GROUP BY g),
ne AS (SELECT k, n, unnest(g) AS t FROM nt),
np AS (SELECT a.k AS ak, b.k AS bk, a.n AS an, b.n AS bn, count(*) AS c FROM ne a JOIN ne b ON a.t = b.t AND a.k < b.k AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n) GROUP BY ALL),
nj AS MATERIALIZED (SELECT ak, bk FROM np WHERE 10 * c >= 7 * (an + bn - c)),
nb AS MATERIALIZED (SELECT ak AS x, bk AS y FROM nj UNION ALL SELECT bk, ak FROM nj),
per AS MATERIALIZED (SELECT unnest(ids) AS doc_id, k, len(ids) - 1 + coalesce(l, 0) AS l FROM nt LEFT JOIN (SELECT x, sum(len(ids)) AS l FROM nb JOIN nt ON k = y GROUP BY x) ON x = k),
edges AS MATERIALIZED (SELECT x, y FROM nb UNION SELECT p.k, q.k FROM per p JOIN per q USING (doc_id)),
reach AS (SELECT k AS x, k AS y FROM nt UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
low AS (SELECT x, min(ids[1]) AS class_id FROM reach JOIN nt ON k = y GROUP BY x)
SELECT doc_id, min(class_id) AS class_id, CAST(sum(l) AS BIGINT) AS n_links FROM per JOIN low ON x = k GROUP BY doc_id HAVING sum(l) > 0
"""
