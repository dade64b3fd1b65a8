"""Personal data and secrets: overlapping candidate spans, boosted trees, calibrated thresholds.

Generators propose every span that might be private. Gradient-boosted trees, trained here on
generated examples in generated surroundings, score each from its format and its context.
Scores are calibrated on held-out examples, and each kind has the lowest threshold that keeps
its precision there; of overlapping spans that pass, the longest is redacted.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spread import spread
from .common import map_arrow, table

KINDS = ("email", "ip", "phone", "card", "ssn", "iban", "secret")
#: No generator matches a text without one of these.
TRIGGER = r"[\p{Nd}@=:]|A[KS]IA|AIza|gh[pousr]_|sk[-_]|pk_|xox|glpat-|eyJ"
PRECISION = 0.98
EXAMPLES, ROUNDS, DEPTH, RATE = 9000, 60, 3, 0.3

GENERATORS = [
    ("email", re.compile(r"[^\s@<>()\[\]{},;:\"'|]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+")),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}")),
    ("phone", re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|(?<!\d)\d{2,4})[ .-]?\d{2,4}[ .-]?\d{2,4}(?:[ .-]?\d{2,4})?(?!\d)")),
    ("phone", re.compile(r"\(?(?<!\d)\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)")),
    ("card", re.compile(r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)")),
    ("ssn", re.compile(r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*\d)[A-Za-z0-9_+/-]{14,}={0,2}")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{12,}|AIza[\w-]{20,}|(?:gh[pousr]_|sk[-_]|pk_|xox\w-|glpat-|eyJ)[\w.-]{16,})")),
    ("secret", re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth\w{0,13})\s{0,3}[=:]\s{0,3}[\"']?([^\s\"']{6,})")),
]
ASK = {
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|mobile|cell|fax|whatsapp|dial)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|credit|debit|mastercard|amex|account|iban|bank)\b"),
    "net": re.compile(r"(?i)\b(?:ip|host|server|address|login|from)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social|security)\b"),
    "secret": re.compile(r"(?i)(?:pass|pwd|secret|token|key|auth|bearer)"),
    "plain": re.compile(r"(?i)\b(?:version|release|build|licen[sc]e|order|invoice|isbn|serial|part|pages?|chapter|section|commit|sha\d*|md5|checksum|hash|uuid|ref|v)\b|#$"),
}
ASSIGNED = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth\w{0,13})\s{0,3}[=:]\s{0,3}[\"']?$")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_", "pk_", "eyJ", "xox", "AIza", "glpat-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "").upper()
    return s.isalnum() and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def propose(text: str) -> list[tuple[int, int, str]]:
    """Distinct (start, end, kind) of all generators, overlapping ones included."""
    out = set()
    for kind, rx in GENERATORS:
        for m in rx.finditer(text):
            a, z = m.span(m.lastindex or 0)
            while z > a and text[z - 1] in ".,;:!?)|" and not (kind == "phone" and text[z - 1] == ")"):
                z -= 1
            if z > a:
                out.add((a, z, kind))
    return sorted(out)


def _neighbour(c: str) -> list[float]:
    return [c.isdigit(), c.isalpha(), c in ".", c in "-_/", c in "+(", c in "#$€£%", c == ""]


def features(text: str, a: int, z: int, kind: str) -> list[float]:
    s, before, after = text[a:z], text[max(0, a - 32) : a], text[z : z + 12]
    digits = "".join(c for c in s if c.isdigit() and c.isascii())
    letters, upper = sum(c.isalpha() for c in s), sum(c.isupper() for c in s)
    counts = [s.count(c) for c in set(s)]
    entropy = -sum(c / len(s) * math.log2(c / len(s)) for c in counts)
    parts = s.split(".") if kind == "ip" else []
    tld = s.rpartition(".")[2] if kind == "email" else ""
    compact = s.replace(" ", "")
    switches = sum(x.isdigit() != y.isdigit() for x, y in zip(compact, compact[1:]))
    return [
        *(kind == k for k in KINDS),
        len(s), len(digits), letters, upper, len(digits) / len(s), sum(c in " .-" for c in s), entropy, len(counts) / len(s), switches,
        13 <= len(digits) <= 19 and luhn(digits), kind == "iban" and mod97(s),
        len(parts) == 4 and all(int(p) < 256 for p in parts), any(len(p) > 1 and p[0] == "0" for p in parts), sum(len(p) > 1 for p in parts),
        tld.isalpha() and len(tld) >= 2, s[:1] == "+", "(" in s, s.startswith(PREFIXES), all(c in "0123456789abcdef" for c in s.lower()),
        kind == "ssn" and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00",
        len(set(digits)) <= 2, bool(re.match(r"(?:19|20)\d\d[-./]?(?:0\d|1[0-2])[-./]?[0-3]\d", s)), s.startswith(("978", "979")),
        bool(re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", s)),
        *_neighbour(text[a - 1 : a] if a else ""), *_neighbour(after[:1]), after[:1] in "." and after[1:2].isdigit() if after else False,
        bool(re.search(r"[=:]\s*[\"']?$", before)), bool(ASSIGNED.search(before)),
        *(bool(rx.search(before)) for rx in ASK.values()),
    ]


class Trees:
    """Gradient boosting of log loss with trees of one depth over quantile bins."""

    def __init__(self, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = 24):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], 1)
        n, width = x.shape
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        score, self.trees = np.full(n, self.base), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node, tree = np.zeros(n, np.int64), []
            for level in range(self.depth):
                many = 1 << level
                best = np.full(many, -np.inf)
                feature, split = np.zeros(many, np.int64), np.full(many, self.bins, np.int64)
                for f in range(width):
                    at = node * self.bins + binned[:, f]
                    gs = np.bincount(at, g, many * self.bins).reshape(many, -1).cumsum(1)
                    hs = np.bincount(at, h, many * self.bins).reshape(many, -1).cumsum(1)
                    gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1)
                    b = gain.argmax(1)
                    v = gain[np.arange(many), b]
                    better = v > best + 1e-12
                    best[better], feature[better], split[better] = v[better], f, b[better]
                tree.append((feature, split))
                node = 2 * node + (binned[np.arange(n), feature[node]] > split[node])
            leaf = -self.rate * np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + 1)
            self.trees.append((tree, leaf))
            score += leaf[node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], 1)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for tree, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, split in tree:
                node = 2 * node + (binned[rows, feature[node]] > split[node])
            out += leaf[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing probabilities by pool-adjacent-violators: (scores, probabilities) for interpolation."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(score[order], y[order]):
        pools.append([float(v), 1.0, float(s), float(s)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            v2, n2, _, hi = pools.pop()
            pools[-1][0] += v2
            pools[-1][1] += n2
            pools[-1][3] = hi
    xs, ys = [], []
    for v, n, lo, hi in pools:
        p = (v + 0.5 * (v / n)) / (n + 0.5)
        xs += [lo, hi] if hi > lo else [lo]
        ys += [p, p] if hi > lo else [p]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


def example(r: random.Random) -> tuple[str, tuple[int, int, str] | None]:
    """A generated text and the private span in it, or None where it only has look-alikes."""
    word = lambda: "".join(r.choice("the an er on re ha ou en st ti le que ion ch sch eau ción é ñ ö al mo ka".split()) for _ in range(r.randint(1, 4)))
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexed = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    b64 = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    caps = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))

    def card() -> str:
        n = r.choice((16, 16, 16, 15, 13, 19))
        s = r.choice("3456" if r.random() < 0.7 else "0123456789") + d(n - 2)
        s += next(c for c in "0123456789" if luhn(s + c))
        return "-".join(s[i : i + 4] for i in range(0, n, 4)) if r.random() < 0.15 else " ".join(s[i : i + 4] for i in range(0, n, 4)) if r.random() < 0.15 else s

    def iban() -> str:
        cc, body = r.choice("DE FR ES GB NL IT CH AT".split()), d(r.choice((14, 18, 20)))
        s = cc + f"{98 - int(''.join(str(int(c, 36)) for c in body + cc + '00')) % 97:02d}" + body
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.4 else s

    octets = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    host = lambda: ".".join([word().replace("é", "e").replace("ñ", "n").replace("ö", "o").replace("ó", "o") + r.choice(("", d(1))), *(["example"] if r.random() < 0.4 else []), r.choice("com org net de fr es io co.uk".split())])
    phone = lambda: r.choice((f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{r.randint(1, 99)} {d(2)} {d(4)} {d(4)}", f"+{r.randint(30, 49)} {d(3)} {d(3)} {d(3)}", f"{d(3)}.{d(3)}.{d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}"))

    kind = r.choice(KINDS)
    good = r.random() < 0.5
    lead = tail = ""
    if good:
        hint = r.random() < 0.3
        if kind == "email":
            s, lead = r.choice((f"{word()}.{d(2)}", f"{word()}.{word()}", f"{word()}{d(2)}", f"{word()}_{word()}", word())) + "@" + host(), "mail "
        elif kind == "ip":
            s, lead = octets(), "IP "
        elif kind == "phone":
            s, lead = phone(), "tel "
        elif kind == "card":
            s, lead = card(), "card "
        elif kind == "ssn":
            s, lead = f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}", "SSN "
        elif kind == "iban":
            s, lead = iban(), "IBAN "
        else:
            s = r.choice((lambda: "AKIA" + caps(16), lambda: "AKIA" + caps(16), lambda: "ghp_" + b64(36), lambda: "sk-" + b64(40), lambda: "AIza" + b64(35), lambda: ""))()
            hint = hint and bool(s)
            lead = "key "
            if not s:
                s = r.choice((hexed(r.choice((16, 18, 20, 32, 40, 64))), b64(r.choice((12, 20, 32))), word() + d(3) + "!"))
                lead, tail = r.choice((('token = "', '"'), ("password=", ""), ("password: ", ""), ("api_key=", ""), ('secret: "', '"'), ("auth_token=", ""), ("pwd=", "")))
                hint = True
        lead = lead if hint else ""
    else:
        bad16 = d(15)
        bad16 += r.choice([c for c in "0123456789" if not luhn(bad16 + c)])
        s = r.choice((
            lambda: f"version {r.randint(0, 9)}.{r.randint(0, 20)}", lambda: f"v{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}", lambda: f"version {d(1)}.{d(1)}.{d(1)}.{d(2)}",
            lambda: f"{r.randint(256, 999)}.{d(3)}.{r.randint(256, 999)}.{d(2)}", lambda: bad16, lambda: "order " + bad16, lambda: d(r.randint(20, 26)), lambda: f"order #{d(8)}-{d(5)}",
            lambda: f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"20{d(2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{d(2)}", lambda: f"${d(1)},{d(3)}.{d(2)}",
            lambda: "@" + word(), lambda: f"{word()}@{word()}", lambda: f"commit {hexed(40)}", lambda: f"sha256 {hexed(64)}", lambda: f"md5: {hexed(32)}", lambda: f"uuid {hexed(8)}-{hexed(4)}-{hexed(4)}-{hexed(4)}-{hexed(12)}",
            lambda: f"{d(3)}-{d(3)}", lambda: f"pages {d(3)}-{d(3)}", lambda: f"{d(2)}.{d(6)}, {d(2)}.{d(6)}", lambda: f"img_20240117_{d(6)}.jpg", lambda: f"{word()}-{word()}-{word()}-{d(4)}", lambda: f"invoice {d(3)}-{d(2)}-{d(5)}",
            lambda: f"{d(4)} {d(4)}", lambda: f"20{d(2)} 20{d(2)} 20{d(2)}", lambda: f"000-{d(2)}-{d(4)}", lambda: f"9{d(2)}-00-{d(4)}", lambda: f"serial {caps(2)}{d(2)} {caps(4)} {d(4)} {caps(4)}", lambda: f"ratio={d(1)}.{d(2)}", lambda: f"{word()}: {word()}",
            lambda: f"https://{host()}/{word()}/{d(6)}", lambda: f"{d(6)}", lambda: f"part {d(4)}-{d(4)}-{d(4)}", lambda: f"{d(3)} {d(3)} {d(3)}",
        ))()
    # words of every context stand near good and bad spans alike, and some spans begin their text
    stray = r.choice("hash order version page ref section card phone from account key total part".split())
    near = [word() for _ in range(r.randint(0, 8))]
    if near and r.random() < 0.25:
        near[r.randrange(len(near))] = stray
    left = " ".join(near) + r.choice((" ", " ", "\n", ", ")) if r.random() < 0.92 else ""
    right = r.choice((" ", " ", ". ", ", ", "\n")) + " ".join(word() for _ in range(r.randint(0, 6))) if r.random() < 0.9 else ""
    text = left + lead + s + tail + right
    at = len(left + lead)
    return text, ((at, at + len(s), kind) if good else None)


class Detector:
    """Trees, calibration and thresholds."""

    def __init__(self, examples: int = EXAMPLES, seed: int = 11, precision: float = PRECISION):
        r = random.Random(seed)
        sets = []
        for count in (examples, examples // 2):
            x, y, k = [], [], []
            for _ in range(count):
                text, truth = example(r)
                for a, z, kind in propose(text):
                    x.append(features(text, a, z, kind))
                    # a part of a private span is private; of overlapping spans the longest is taken later
                    y.append(truth is not None and kind == truth[2] and truth[0] <= a and z <= truth[1])
                    k.append(kind)
            sets.append((np.array(x, np.float64), np.array(y, np.float64), np.array(k)))
        (x, y, _), (hx, hy, hk) = sets
        self.trees = Trees().fit(x, y)
        score = self.trees.score(hx)
        self.curves, self.least = {}, {}
        for kind in KINDS:
            mine = hk == kind
            self.curves[kind] = isotonic(score[mine], hy[mine])
            p = np.interp(score[mine], *self.curves[kind])
            order = np.argsort(-p, kind="stable")
            q, hit = p[order], hy[mine][order]
            ok = np.nonzero(np.cumsum(hit) / np.arange(1, len(hit) + 1) >= precision)[0]
            self.least[kind] = max(0.5, float(q[ok[-1]])) if len(ok) else 0.99

    def spans(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, probability) of what to redact, in order and without overlaps."""
        found = propose(text)
        if not found:
            return []
        x = np.array([features(text, *c) for c in found], np.float64)
        good = []
        for (a, z, kind), v in zip(found, self.trees.score(x)):
            q = float(np.interp(v, *self.curves[kind]))
            if q >= self.least[kind]:
                good.append((z - a, q, -a, z, kind))
        return longest([(-a, z, kind, round(q, 4)) for _, q, a, z, kind in sorted(good, reverse=True)])


def longest(ranked: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Spans taken in the order given, each unless it overlaps one taken before; in order of their starts.

    Taken spans are disjoint, so only the neighbours of a span's place in their order can overlap it.
    """
    starts: list[int] = []
    taken: dict[int, tuple[int, int, str, float]] = {}
    for span in ranked:
        i = bisect_left(starts, span[0])
        if (i == len(starts) or starts[i] >= span[1]) and (i == 0 or taken[starts[i - 1]][1] <= span[0]):
            starts.insert(i, span[0])
            taken[span[0]] = span
    return [taken[a] for a in starts]


@lru_cache(maxsize=4)
def detector(examples: int = EXAMPLES, seed: int = 11, precision: float = PRECISION) -> Detector:
    return Detector(examples, seed, precision)


def redact(text: str, spans) -> str:
    out, at = [], 0
    for a, z, kind, _ in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = z
    return "".join(out) + text[at:]


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("probability", pa.float64())]))


def find_private(docs: DataFrame, model: Detector | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, redacted) of the documents that have something to redact; others give no row.

    Spans are characters [start, end) of the text. Texts without any trigger character, null
    and empty ones are passed over in the JVM. Whole texts of any length are searched; of equally
    long overlapping spans the more probable is taken, then the first; repeated rows and null ids
    stay; other columns are ignored; an empty table gives no rows. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or detector())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                keep, spans, texts = [], [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    s = d.spans(text)
                    if s:
                        keep.append(i)
                        spans.append([dict(zip(("start", "end", "kind", "probability"), x)) for x in s])
                        texts.append(redact(text, s))
                if keep:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(spans, SPANS), pa.array(texts, pa.string())], names=["doc_id", "spans", "redacted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).where(F.col(f"`{text_col}`").rlike(TRIGGER))
    return map_arrow(spread(rows), run, f"doc_id {kind}, spans array<struct<start:int,end:int,kind:string,probability:double>>, redacted string")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents"))
