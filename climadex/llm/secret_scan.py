"""Secret scans: fixed rules, and a character convolutional network for further spans.

The rules give the base spans (``assign``, ``access``, ``hex``).  Candidates are the runs of
12 or more token characters of every whole text that are no plain word (see ``candidates``).
A small network in numpy (one-hot characters of the candidate and its surroundings, a
convolution, maximum over positions, a logistic output) scores each of them with its context.
It is trained on labelled findings: rule findings of a bounded sample of the corpus, with
their lead taken away in half of them, and made-up secrets, against the sample's words, its
other candidates (but for those that look like secrets to a network that has not seen them)
and made-up identifiers.  Its output is calibrated, and the threshold is
the highest one that keeps the wanted recall on secrets of formats held out from training.
Candidates beyond the threshold which touch no base span are added as kind ``cnn``.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled_rows, slices, texts_of

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A failing match of these two would run to the end of its characters, where none could pass.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{12,}")
_PLAIN = re.compile(r"[A-Za-z]?[a-z._-]*|[A-Z._-]*|[0-9._/-]*")
_SEPARATOR = re.compile(r"[:=]")
#: Characters before the candidate, of the candidate and after it.
BEFORE, INSIDE, AFTER = 24, 48, 8
WIDTH, FILTERS, CLASSES = 5, 24, 40
SEED = 3
#: Mark of a candidate that may be a secret or not.
UNKNOWN = 2


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind."""
    out = [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if _SEPARATOR.search(text):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of 12 or more of ``[A-Za-z0-9+/_=.~-]``, full stops at the end left off.

    Left out are runs of lower-case letters (the first one in either case), of upper-case
    letters, and of digits, each with ``. _ -`` between: words, numbers and addresses.
    """
    out = []
    for m in CANDIDATE.finditer(text):
        s = m[0].rstrip(".")
        if len(s) >= 12 and not _PLAIN.fullmatch(s):
            out.append((m.start(), m.start() + len(s)))
    return out


# Characters by class: digits, letters by case and part of the alphabet, and the marks that matter.
_MARKS = "\n \t:=\"'`,;.()[]{}<>/+_-@#$%&*|\\!?"
_CLASS = np.full(256, 1, np.uint8)
for _i, _c in enumerate(string.digits):
    _CLASS[ord(_c)] = 2 + _i // 5
for _c in string.ascii_lowercase:
    _CLASS[ord(_c)] = 4 if _c in "abcdef" else 5 if _c in "aeiouy" else 6
for _c in string.ascii_uppercase:
    _CLASS[ord(_c)] = 7 if _c in "ABCDEF" else 8 if _c in "AEIOUY" else 9
for _i, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 10 + min(_i, CLASSES - 11)


def _of(s: str) -> np.ndarray:
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
    return _CLASS[np.minimum(c, 255)]


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Character classes around a candidate; 0 where there is no character.

    A candidate longer than INSIDE has several windows, each with what stands around the
    whole candidate; together they show all of it.
    """
    left, right = _of(text[max(0, start - BEFORE) : start]), _of(text[end : end + AFTER])
    out = []
    last = max(start, end - INSIDE)
    for a in [*range(start, last, INSIDE), last]:
        x = np.zeros(BEFORE + INSIDE + AFTER, np.uint8)
        x[BEFORE - len(left) : BEFORE] = left
        s = _of(text[a : min(end, a + INSIDE)])
        x[BEFORE : BEFORE + len(s)] = s
        x[BEFORE + INSIDE : BEFORE + INSIDE + len(right)] = right
        out.append(x)
    return out


def window(text: str, start: int, end: int) -> np.ndarray:
    """The first window."""
    return windows(text, start, min(end, start + INSIDE))[0] if end - start > INSIDE else windows(text, start, end)[0]


@dataclass
class CharCnn:
    kernel: np.ndarray  # (FILTERS, WIDTH, CLASSES)
    shift: np.ndarray
    out: np.ndarray
    bias: float
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 0.0  # of the calibrated log-odds

    @classmethod
    def fresh(cls) -> CharCnn:
        rng = np.random.default_rng(SEED)
        return cls(rng.normal(0, 0.2, (FILTERS, WIDTH, CLASSES)), np.zeros(FILTERS), rng.normal(0, 0.2, 2 * FILTERS), 0.0)

    def _forward(self, x: np.ndarray):
        n = x.shape[1] - WIDTH + 1
        # One-hot input: a convolution is a sum of looked-up kernel columns.
        a = self.shift + sum(self.kernel[:, k, :].T[x[:, k : k + n]] for k in range(WIDTH))
        inside = slice(BEFORE - WIDTH + 1, BEFORE + INSIDE)
        outside = np.concatenate([a[:, : inside.start], a[:, inside.stop :]], axis=1)
        return a, inside, a[:, inside].max(axis=1), outside.max(axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for i in range(0, len(x), 512):
            _, _, p, q = self._forward(x[i : i + 512])
            out[i : i + 512] = np.maximum(np.hstack([p, q]), 0) @ self.out + self.bias
        return out

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log-odds."""
        return self.scale * self.logits(x) + self.offset

    def train(self, x: np.ndarray, y: np.ndarray, *, epochs: int = 12, rate: float = 0.02) -> None:
        rng = np.random.default_rng(SEED + 1)
        caches = [np.full_like(self.kernel, 1e-8), np.full_like(self.shift, 1e-8), np.full_like(self.out, 1e-8), np.array(1e-8)]
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                xb = x[at]
                a, inside, p, q = self._forward(xb)
                h = np.hstack([p, q])
                r = np.maximum(h, 0)
                d = (1 / (1 + np.exp(-np.clip(r @ self.out + self.bias, -40, 40))) - y[at]) * weight[at] / len(at)
                dr = d[:, None] * self.out * (h > 0)
                gk, gs = np.zeros_like(self.kernel), dr[:, :FILTERS].sum(axis=0) + dr[:, FILTERS:].sum(axis=0)
                spots_in = a[:, inside].argmax(axis=1) + inside.start
                hidden = a.copy()
                hidden[:, inside] = -np.inf
                spots_out = hidden.argmax(axis=1)
                rows, filters = np.arange(len(at))[:, None], np.arange(FILTERS)[None, :]
                for spots, g in ((spots_in, dr[:, :FILTERS]), (spots_out, dr[:, FILTERS:])):
                    for k in range(WIDTH):
                        np.add.at(gk, (np.broadcast_to(filters, spots.shape), k, xb[rows, spots + k]), g)
                grads = [gk + 1e-4 * self.kernel, gs, r.T @ d + 1e-4 * self.out, np.array(d.sum())]
                for c, g in zip(caches, grads):
                    c *= 0.95
                    c += 0.05 * g * g
                self.kernel -= rate * grads[0] / np.sqrt(caches[0]) * 0.3
                self.shift -= rate * grads[1] / np.sqrt(caches[1]) * 0.3
                self.out -= rate * grads[2] / np.sqrt(caches[2]) * 0.3
                self.bias -= float(rate * grads[3] / np.sqrt(caches[3]) * 0.3)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on findings and others set aside."""
        z = self.logits(x)
        s, o = 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(s * z + o, -40, 40)))
            d = p - y
            w = p * (1 - p) + 1e-6
            h = np.array([[np.sum(w * z * z) + 1e-3, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 1e-3]])
            s, o = np.array([s, o]) - 0.3 * np.linalg.solve(h, [np.sum(d * z) + 1e-3 * s, np.sum(d)])
        self.scale, self.offset = float(s), float(o)

    def constrain(self, x: np.ndarray, recall: float) -> None:
        """The highest threshold that finds the share ``recall`` of the secrets in ``x``."""
        z = np.sort(self.odds(x))
        self.threshold = float(z[int((1 - recall) * len(z))])


_ALNUM = string.ascii_letters + string.digits
_HEX = "0123456789abcdef"
#: Parts of a format: a fixed lead, an alphabet and least and largest length, and so on.
TRAINED = [
    ("", _HEX, 32, 64),
    ("", _ALNUM, 20, 48),
    ("", _ALNUM + "+/", 24, 64, "==", "", 1, 1),
    ("AKIA", string.ascii_uppercase + string.digits, 16, 16),
    ("ghp_", _ALNUM, 36, 36),
    ("xoxb-", string.digits, 11, 11, "-", _ALNUM, 24, 24),
    ("", _ALNUM + "_-", 24, 43),
    ("pk_live_", _ALNUM, 24, 24),
    ("", string.ascii_uppercase + "234567", 32, 52),
    ("", string.ascii_lowercase + string.digits, 20, 40),
]
#: Formats that are never trained on: they set the threshold.
HELD_OUT = [
    ("sk-", _ALNUM, 32, 48),
    ("eyJ", _ALNUM, 20, 40, ".eyJ", _ALNUM + "_-", 30, 60, ".", _ALNUM + "_-", 43, 43),
    ("glpat-", _ALNUM + "_-", 20, 20),
    ("", _HEX, 8, 8, "-", _HEX, 4, 4, "-4", _HEX, 3, 3, "-a", _HEX, 3, 3, "-", _HEX, 12, 12),
    ("", "0123456789ABCDEF", 40, 64),
]
LEADS = ["key = ", "key: ", "auth_key=", "bearer ", "Authorization: Bearer ", 'access_key = "', "private_key: ", "credential = '", "pwd=", "client id ", " ", " ", "=", "('"]


def _filled(rng: np.random.Generator, parts: tuple) -> str:
    out = ""
    for lead, alphabet, low, high in zip(*(parts[i::4] for i in range(4))):
        out += lead + ("".join(rng.choice(list(alphabet), int(rng.integers(low, high + 1)))) if alphabet else "")
    return out


def _placed(rng: np.random.Generator, s: str, lead: str, words: list[str]) -> tuple[str, int, int]:
    around = [str(w) for w in rng.choice(words, 8)] if words else []
    head = " ".join(around[:4]) + " " + lead
    return head + s + " " + " ".join(around[4:]), len(head), len(head) + len(s)


def made_up(rng: np.random.Generator, words: list[str], formats: list[tuple], n: int) -> list[tuple[str, int, int]]:
    """Secrets of the given formats in made-up surroundings: (text, start, end)."""
    return [_placed(rng, _filled(rng, formats[rng.integers(len(formats))]), LEADS[rng.integers(len(LEADS))], words) for _ in range(n)]


def identifiers(rng: np.random.Generator, words: list[str], n: int) -> list[tuple[str, int, int]]:
    """Long tokens that are no secrets: names, paths, dates and numbers, in the same surroundings."""
    words = words or ["value", "name", "number"]

    def word() -> str:
        return str(rng.choice(words)).strip(".,;:!?") or "x"

    def digits(k: int) -> str:
        return "".join(rng.choice(list(string.digits), k))

    shapes = [
        lambda: "".join(word().capitalize() for _ in range(int(rng.integers(2, 5)))),
        lambda: "_".join(word().lower() for _ in range(int(rng.integers(2, 5)))) + digits(int(rng.integers(0, 4))),
        lambda: "-".join(word() for _ in range(int(rng.integers(2, 5)))) + "-" + digits(2),
        lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}T{digits(2)}-{digits(2)}-{digits(2)}Z",
        lambda: f"/{word().lower()}/{word().lower()}/{word()}_{digits(3)}.txt",
        lambda: f"www.{word().lower()}{digits(1)}.{word().lower()}.com/{word()}",
        lambda: f"IMG_20{digits(6)}_{digits(6)}.jpg",
        lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}-{word().lower()}",
        lambda: word().upper() + "_" + word().upper() + "_" + digits(2),
        lambda: f"{word()}={word()}/{digits(4)}",
        lambda: f"DE{digits(20)}",
    ]
    return [_placed(rng, shapes[rng.integers(len(shapes))](), LEADS[rng.integers(len(LEADS))], words) for _ in range(n)]


def train(docs: DataFrame, *, train_docs: int = 20_000, train_windows: int = 16_000, recall: float = 0.95) -> CharCnn:
    """Fit on about ``train_docs`` documents (by hash of doc_id; scanned once and stored).

    At most 20 windows of each are taken, and at most ``train_windows`` of all of them are used.
    """
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = sampled_rows(sample, train_docs, "secrets")

    def examples(batches):
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                base = base_spans(text)
                found = candidates(text)
                own = [(1, a, b) for k, a, b in base if k != "assign"] + [(1, *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
                other = [(UNKNOWN, a, b) for a, b in found if not any(a < e and s < b for _, s, e in base)]
                # Ordinary words and short tokens are counter-examples as well.
                plain = [(0, m.start(), m.end()) for m, _ in zip(re.finditer(r"[^\s]{8,}", text), range(8)) if not any(m.start() < e and s < m.end() for s, e in found + [x[1:] for x in base])]
                for y, a, b in own[:6] + other[:8] + plain[: 2 if doc % 4 else 6]:
                    rows.append((doc, y, window(text, a, b).tobytes(), text[a:b] if y == 0 and b - a < 24 else ""))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.string()))], ["doc_id", "y", "x", "word"])

    # Findings and others each within their share of the windows; a task sorts those of the sample alone.
    rows = chosen.mapInArrow(examples, "doc_id long, y int, x binary, word string")
    mark = F.xxhash64("doc_id", "x")
    rows = rows.where("y = 1").orderBy(mark, "x").limit(train_windows // 4).unionByName(rows.where("y != 1").orderBy(mark, "x").limit(train_windows // 2)).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["y"], bytes(r["x"])))
    words = sorted({r["word"] for r in rows if r["word"].isalpha()})[:5000]
    rng = np.random.default_rng(SEED)
    x = [np.frombuffer(r["x"], np.uint8).copy() for r in rows]
    for k, r in enumerate(rows):
        if r["y"] == 1 and k % 2:  # the characters of a secret tell it as well as its lead
            x[k][:BEFORE] = _of(" ".join(words[k % len(words) :][:4]).rjust(BEFORE)[-BEFORE + 1 :] + " ") if words else 0
    some = train_windows // 8
    x += [window(*t) for t in made_up(rng, words, TRAINED, some) + identifiers(rng, words, some)]
    y = np.array([r["y"] for r in rows] + [1] * some + [0] * some, float)
    x = np.stack(x)
    order = rng.permutation(len(x))
    x, y = x[order], y[order]
    aside = np.arange(len(x)) % 5 == 4
    # Candidates that no rule has may be secrets: those that a first network, which has not
    # seen them, takes for one are examples of neither kind.
    if (y == UNKNOWN).any():
        first = CharCnn.fresh()
        sure = ~aside & (y != UNKNOWN)
        first.train(x[sure], y[sure], epochs=4)
        keep = (y != UNKNOWN) | (first.logits(x) < 0)
        x, y, aside = x[keep], np.where(y[keep] == 1, 1.0, 0.0), aside[keep]
    net = CharCnn.fresh()
    net.train(x[~aside], y[~aside])
    net.calibrate(x[aside], y[aside])
    net.constrain(np.stack([window(*t) for t in made_up(rng, words, HELD_OUT, 1000)]), recall)
    return net


def scan_text(text: str, net: CharCnn | None) -> list[tuple[str, int, int]]:
    """Base spans and the network's, by start, then kind."""
    base = base_spans(text)
    if net is None:
        return base
    found = candidates(text)
    if not found:
        return base
    seen = [windows(text, a, b) for a, b in found]
    p = np.maximum.reduceat(net.odds(np.stack([w for s in seen for w in s])), np.cumsum([0, *map(len, seen)])[:-1])
    new = [("cnn", a, b) for (a, b), s in zip(found, p) if s >= net.threshold and not any(a < e and t < b for _, t, e in base)]
    return sorted(base + new, key=lambda s: (s[1], KINDS.index(s[0])))


def secret_spans(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, spans): spans as an array of (kind, start, end), a row for each row of ``docs``.

    Positions are code points of the whole text, ends exclusive.  A null or empty text has
    no span; rows of the same doc_id, or without one, are scanned each by itself (rows
    without a doc_id are not trained on, repeated ids once); other columns are left out.
    Texts of any length are scanned whole, and of a long candidate every window; an empty
    table gives an empty result.
    """
    net = train(docs, **how)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in slices(batches):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t, net)] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long>>")
