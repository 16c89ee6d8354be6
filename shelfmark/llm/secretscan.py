"""Secret scan: fixed base patterns, and a character network over candidates.

Base findings (``assign``, ``access``, ``hex``) come from patterns and always
stay. Further candidates are all runs of 16 or more token characters, and what
base findings leave of such runs if that is 16 characters or more. Every one of
them is read with its surroundings by a small convolutional network in numpy:
one-hot characters with a mark for the candidate, width-5 filters, maxima inside
and outside the candidate, one logistic output. A candidate longer than INSIDE
is read whole, in overlapping windows of INSIDE characters; the highest score
counts. The network is trained on labelled findings, a table if there is one
(``findings_of``) or those made here from a seed (``labelled_findings``); Platt
scaling on a held-out part calibrates it, and the threshold is the largest that
keeps the wanted recall there. Accepted candidates are findings of kind ``net``.

Spans are code points of the whole text, end exclusive, ordered by start, then
kind as listed in KINDS. Null and empty texts have no findings; very long texts
are scanned whole, in time and memory proportional to their length. Every row is
scanned by itself, so ties and repeats are scanned alike. Other columns are
ignored. An empty table gives no rows; without labelled secrets nothing but base
findings is reported.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import small_batches

KINDS = ("assign", "access", "hex", "net")
#: The base patterns, and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGN, MIN_ACCESS = 8, 16
LEAST = 16
RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")
AROUND, INSIDE, STEP = 20, 48, 24
WIDTH, FILTERS = 5, 32
RECALL = 0.98
_ALPHABET = 98  # space to tilde, white space, non-ASCII, and padding


@dataclass(frozen=True)
class Finding:
    text: str
    start: int
    end: int
    secret: bool
    shape: str = ""


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base findings."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of token characters without what lies in a base finding (``base`` is
    in order of start); pieces of LEAST characters or more."""
    out, k = [], 0
    for m in RUN.finditer(text):
        at, end = m.span()
        while k < len(base) and base[k][2] <= at:
            k += 1
        for start, _, stop in islice(base, k, None):
            if start >= end:
                break
            if start - at >= LEAST:
                out.append((at, start))
            at = max(at, stop)
        if end - at >= LEAST:
            out.append((at, end))
    return out


def _windows(items: Iterable[tuple[str, int, int]]) -> Iterator[tuple[int, str, int, int]]:
    """(item, text, start, end) of windows over each whole candidate."""
    for k, (text, a, b) in enumerate(items):
        for at in range(a, max(a, b - INSIDE), STEP):
            yield k, text, at, at + INSIDE
        yield k, text, max(a, b - INSIDE), b


def _encode(items: list[tuple[str, int, int]]) -> np.ndarray:
    """Character codes and candidate marks: (n, length, 2)."""
    size = 2 * AROUND + INSIDE
    out = np.zeros((len(items), size, 2), np.int16)
    out[:, :, 0] = _ALPHABET - 1
    for k, (text, a, b) in enumerate(items):
        own, left, right = text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND]
        for at, part, mark in ((AROUND - len(left), left, 0), (AROUND, own, 1), (AROUND + INSIDE, right, 0)):
            codes = [ord(c) - 32 if " " <= c <= "~" else 95 if c.isspace() else 96 for c in part]
            out[k, at : at + len(codes), 0] = codes
            out[k, at : at + len(codes), 1] = mark
    return out


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rng = rng
        made = {
            "embed": rng.normal(0, 0.5, (_ALPHABET, 8)),
            "mark": rng.normal(0, 0.5, (2, 8)),
            "filter": rng.normal(0, (2 / (8 * WIDTH)) ** 0.5, (WIDTH * 8, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": rng.normal(0, 0.2, 2 * FILTERS),
            "shift": np.zeros(1),
        }
        self.p = {name: value.astype(np.float32) for name, value in made.items()}
        self.scale, self.offset, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray) -> tuple:
        p = self.p
        e = p["embed"][x[:, :, 0]] + p["mark"][x[:, :, 1]]
        n, size, d = e.shape
        windows = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, size - WIDTH + 1, WIDTH * d)
        h = np.maximum(windows @ p["filter"] + p["bias"], 0)
        inside = x[:, WIDTH // 2 : size - WIDTH // 2, 1, None] > 0
        parts = [np.where(inside, h, -1.0), np.where(inside, -1.0, h)]
        peaks = [q.argmax(1) for q in parts]
        top = np.concatenate([np.maximum(np.take_along_axis(h, k[:, None], 1)[:, 0], 0) for k in peaks], 1)
        return windows, h, peaks, top, top @ p["out"] + p["shift"][0]

    def _highest(self, items: list[tuple[str, int, int]]) -> np.ndarray:
        """The highest output over the windows of each candidate, in bounded batches."""
        out = np.full(len(items), -np.inf)
        windows = _windows(items)
        while part := list(islice(windows, 256)):
            np.maximum.at(out, [w[0] for w in part], self._forward(_encode([w[1:] for w in part]))[-1])
        return out

    def score(self, items: list[tuple[str, int, int]]) -> np.ndarray:
        """Calibrated probabilities, in bounded batches."""
        return 1 / (1 + np.exp(-np.clip(self.scale * self._highest(items) + self.offset, -50, 50)))

    def _leading(self, x: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The window of each candidate that decides its score."""
        best = start.copy()
        many = np.flatnonzero(count > 1)
        if len(many):
            z = self._forward(x[np.concatenate([np.arange(start[i], start[i] + count[i]) for i in many])])[-1]
            for i, own in zip(many, np.split(z, np.cumsum(count[many])[:-1])):
                best[i] += own.argmax()
        return best

    def fit(self, items: list[tuple[str, int, int]], y: np.ndarray, epochs: int = 12, batch: int = 96, rate: float = 5e-3) -> None:
        parts = list(_windows(items))
        x = _encode([w[1:] for w in parts])
        count = np.bincount([w[0] for w in parts], minlength=len(items))
        start = np.cumsum(count) - count
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        turn = 0
        for epoch in range(epochs):
            step = np.float32(rate * (1 - epoch / epochs))
            order = self.rng.permutation(len(y))
            for k in range(0, len(y), batch):
                own = order[k : k + batch]
                label, own = y[own], self._leading(x, start[own], count[own])
                windows, h, peaks, top, z = self._forward(x[own])
                miss = ((1 / (1 + np.exp(-np.clip(z, -50, 50))) - label) / len(own)).astype(np.float32)
                g = {"out": top.T @ miss, "shift": np.array([miss.sum()])}
                dtop = miss[:, None] * self.p["out"]
                dh = np.zeros_like(h)
                rows = np.arange(len(own))[:, None]
                for part, peak in enumerate(peaks):
                    value = dtop[:, part * FILTERS : (part + 1) * FILTERS]
                    dh[rows, peak, np.arange(FILTERS)] += value
                dh *= h > 0
                flat = dh.reshape(-1, FILTERS)
                g["filter"] = windows.reshape(-1, windows.shape[2]).T @ flat
                g["bias"] = flat.sum(0)
                dw = (flat @ self.p["filter"].T).reshape(len(own), -1, WIDTH, 8)
                de = np.zeros((len(own), x.shape[1], 8), np.float32)
                for j in range(WIDTH):
                    de[:, j : j + dw.shape[1]] += dw[:, :, j]
                for c, name in enumerate(("embed", "mark")):
                    at, n = x[own][:, :, c].ravel(), len(self.p[name])
                    g[name] = np.stack([np.bincount(at, de[:, :, d].ravel(), n) for d in range(8)], axis=1)
                turn += 1
                for name, value in g.items():
                    value = value.astype(np.float32)
                    first[name] = 0.9 * first[name] + 0.1 * value
                    second[name] = 0.999 * second[name] + 0.001 * value**2
                    self.p[name] = self.p[name] - step * (first[name] / (1 - 0.9**turn)) / (np.sqrt(second[name] / (1 - 0.999**turn)) + 1e-8)

    def calibrate(self, items: list[tuple[str, int, int]], y: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling, then the largest threshold of at least ``recall``."""
        z = self._highest(items)
        a, b = 1.0, 0.0
        hits = y.sum()
        soft = np.where(y > 0, (hits + 1) / (hits + 2), 1 / (len(y) - hits + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
            w = p * (1 - p) + 1e-9
            grad = np.array([(z * (p - soft)).sum(), (p - soft).sum()])
            hess = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(hess, grad)
            a, b = a - step[0], b - step[1]
        self.scale, self.offset = float(a), float(b)
        p = np.sort(1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))[y > 0])
        self.threshold = float(p[int(np.floor((1 - recall) * len(p)))]) if len(p) else 1.0


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_MIXED = _UPPER + _LOWER + _DIGITS
_SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "tion", "ing", "ver", "sch", "lich", "eau", "que", "ción", "mente", "os", "la", "ble", "st", "ung", "keit", "heit", "ge", "zu", "pf", "do", "ra", "elle", "aise"]


class _Maker:
    """Runs of characters in the shapes that keys and harmless things have."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def draw(self, chars: str, low: int, high: int = 0) -> str:
        return "".join(self.rng.choice(chars) for _ in range(self.rng.randint(low, high or low)))

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(1, 5)))

    def plain(self) -> str:
        """A word of common endings, or one of consonants and vowels in turn."""
        if self.rng.random() < 0.5:
            return "".join(c for c in self.word() if c.isascii())
        return "".join(self.draw("bcdfghjklmnprstvwxyz", 1) + self.draw("aeiouy", 1, 2) + self.draw("lmnrst", 0, 1) for _ in range(self.rng.randint(1, 4)))

    def piece(self) -> str:
        p, rng = self.plain, self.rng
        return rng.choice([p() + p(), p() + p() + p(), p() + str(rng.randrange(100)), p() + "_" + p(), p() + "_" + p() + "_" + p(), p() + "-" + p(), str(rng.randrange(2030))])

    def amid(self, middle: str) -> str:
        """``middle`` in a long harmless run."""
        ends = [self.piece() for _ in range(self.rng.randint(1, 5))], [self.piece() for _ in range(self.rng.randint(1, 4))]
        between = self.rng.choice(["/", ".", "_", "-", "=", "/.", "/=", "_="])
        parts = [*ends[0], middle, *ends[1], self.plain() + self.rng.choice([".html", ".txt", ".py", ".mp4", "_id"])]
        return "".join(part + self.rng.choice(between) for part in parts[:-1]) + parts[-1]

    def secrets(self) -> dict[str, Callable[[], str]]:
        d, rng = self.draw, self.rng
        return {
            "short hex": lambda: d(_DIGITS + "abcdef", 20, 31),
            "base64": lambda: d(_MIXED + "+/", 20, 64) + rng.choice(["", "=", "=="]),
            "prefixed": lambda: rng.choice(["sk_live_", "ghp_", "xoxb-", "glpat-", "pk-", "SG."]) + d(_MIXED, 18, 40),
            "web token": lambda: "eyJ" + d(_MIXED + "_-", 30) + "." + d(_MIXED + "_-", 16, 40),
            "mixed": lambda: d(_MIXED, 18, 48),
            "letters": lambda: d(_UPPER + _LOWER, 20, 40),
            "upper": lambda: d(_UPPER + _DIGITS, 18, 40),
            "groups": lambda: "-".join(d(_DIGITS + "abcdef", n) for n in (8, 4, 4, 4, 12)),
            "amid a run": lambda: self.amid(d(_MIXED, 24, 48)),
        }

    def harmless(self) -> dict[str, Callable[[], str]]:
        d, rng, p = self.draw, self.rng, self.plain
        return {
            "site": lambda: "www." + p() + p() + str(rng.randrange(100)) + ".example.com/" + p() + "/" + str(rng.randrange(1000)),
            "path": lambda: "/".join([p(), p() + str(rng.randrange(30)), p(), p() + "." + rng.choice(["html", "txt", "py", "mp4"])]),
            "time": lambda: "-".join([d(_DIGITS, 4), d(_DIGITS, 2), d(_DIGITS, 2)]) + "T" + d(_DIGITS, 2) + "-" + d(_DIGITS, 6) + "Z",
            "slug": lambda: "-".join(p() for _ in range(rng.randint(3, 6))) + "-" + str(rng.randrange(2030)),
            "name": lambda: "_".join(p() for _ in range(rng.randint(2, 5))) + "_" + str(rng.randrange(99)) + "_id",
            "version": lambda: "v" + ".".join(str(rng.randrange(40)) for _ in range(8)) + "-release",
            "rule": lambda: "=" * rng.randint(12, 30) + p() + str(rng.randrange(9)) + "=" * rng.randint(3, 9),
            "numbered word": lambda: p() + p() + p() + p() + str(rng.randrange(1000)) + p(),
            "dotted": lambda: p() + str(rng.randrange(100)) + "." + p() + "." + p() + str(rng.randrange(10)) + "..." + p(),
            "long word": lambda: p() + p() + p() + p() + rng.choice(["", ".", "..."]),
            "Title word": lambda: (p() + p() + p() + p()).capitalize() + rng.choice(["", "-" + p(), "."]),
            "UPPER word": lambda: (p() + p() + p() + p()).upper() + rng.choice(["", ".", "!"]),
            "dashes": lambda: rng.choice("-_=.") * rng.randint(16, 80),
            "digits": lambda: d(_DIGITS, 16, 24),
            "decimals": lambda: d(_DIGITS, 1, 3) + "." + d(_DIGITS, 14, 20),
            "amid a run": lambda: self.amid(self.piece()),
            "chain": lambda: self.amid(self.amid(self.piece())),
        }


def labelled_findings(count: int = 4800, seed: int = 11, shapes: set[str] | None = None) -> list[Finding]:
    """Labelled findings made from a seed: keys in the shapes and surroundings
    in which they leak, and harmless runs of the same characters; with
    ``shapes`` only of those (as "secret: mixed", "harmless: path")."""
    make = _Maker(seed)
    rng = make.rng
    kinds = [(f"secret: {n}", True, f) for n, f in make.secrets().items()] + [(f"harmless: {n}", False, f) for n, f in make.harmless().items()]
    kinds = [k for k in kinds if shapes is None or k[0] in shapes]
    sides = [[k for k in kinds if k[1] == side] for side in (True, False)]
    out = []
    while len(out) < count:
        shape, is_secret, draw = rng.choice(rng.choice([s for s in sides if s]))
        run = draw()
        before = " ".join(make.word() for _ in range(3)) + rng.choice([" ", "\n", ", "])
        if is_secret:
            before += rng.choice(["key: ", "auth=", "Bearer ", "pwd=", "credentials ", "private ", "", "", 'value="', "export K="])
        else:
            before += rng.choice(["see ", "at ", "http://", "file ", "", "", "(", "id ", "ref: "])
        text = before + run + rng.choice([" ", '"', "\n", ". ", ") "]) + " ".join(make.word() for _ in range(3))
        found = [c for c in candidates(text, base_spans(text)) if c[0] <= len(before) < c[1]]
        if found:
            out.append(Finding(text, *found[0], is_secret, shape))
    return out


def findings_of(table: DataFrame, limit: int = 20_000) -> list[Finding]:
    """Labelled findings of a table (text, start, end, secret): at most ``limit``,
    the smallest hashes; rows with nulls are left out."""
    rows = table.select("text", "start", "end", "secret").dropna()
    rows = rows.orderBy(F.xxhash64("text", "start", "end"), "text", "start", "end").limit(limit)
    return [Finding(r["text"], r["start"], r["end"], bool(r["secret"])) for r in rows.collect()]


def train(findings: list[Finding], seed: int = 7, recall: float = RECALL) -> Network:
    """A network fitted on three quarters of ``findings``, calibrated on the rest.
    Without secrets or without others among them it accepts nothing."""
    order = np.random.default_rng(seed).permutation(len(findings))
    items = [(findings[i].text, findings[i].start, findings[i].end) for i in order]
    y = np.array([float(findings[i].secret) for i in order])
    cut = len(items) * 3 // 4
    net = Network(seed)
    if not 0 < y[:cut].sum() < cut or not y[cut:].any():
        net.threshold = np.inf
        return net
    net.fit(items[:cut], y[:cut])
    net.calibrate(items[cut:], y[cut:], recall)
    return net


@cache
def default_network() -> Network:
    """The network of the findings that are made here; trained once a process."""
    return train(labelled_findings())


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and ``findings``, an array of (kind, start, end, text, score), for
    each row; base findings have score 1."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found, asked = [], []
                for row, text in enumerate(part.column(1)):
                    text = text.as_py() or ""
                    base = base_spans(text)
                    found.append([(s, k, e, text[s:e], 1.0) for s, k, e in base])
                    for a, b in candidates(text, base):
                        # only the surroundings that the network reads
                        left = max(0, a - AROUND)
                        asked.append((row, a, b, (text[left : b + AROUND], a - left, b - left)))
                for (row, a, b, (near, x, y)), p in zip(asked, model.score([q[3] for q in asked])):
                    if p >= model.threshold:
                        found[row].append((a, 3, b, near[x:y], float(p)))
                rows = [[{"kind": KINDS[k], "start": s, "end": e, "text": t, "score": p} for s, k, e, t, p in sorted(f)] for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(item))], names=["doc_id", "findings"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, findings array<struct<kind:string,start:long,end:long,text:string,score:double>>")


def digest(found: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans, and all spans as text."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda x: x["kind"] != "net")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )
