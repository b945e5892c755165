"""Language identification: sparse multinomial logistic regression.

Features are hashed character n-grams of orders 1 to 3 of the whole lower-cased text, as
shares of the text's n-grams weighted by inverse document frequency (counted over all
training documents).  The weights are learned by follow-the-regularised-leader with an
elastic net on a bounded sample per language, stored once, then a temperature is fitted on rows of that
sample set aside.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod5, sampled_rows, slices, sum_vectors, texts_of, vector_blocks

DIMS = 1 << 15
_LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"
#: Text whose n-grams are held at a time.
NGRAM_BYTES = 1 << 20
SCALE = 100.0


def ngrams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams of each order (DIMS for those that cross texts), starts of the texts."""
    parts = [t.lower().replace("\0", " ") for t in texts]
    starts, at = [], 0
    for p in parts:
        starts.append(at)
        at += len(p) + 1
    c = np.frombuffer(("\0".join(parts) + "\0\0\0").encode("utf-32-le", "surrogatepass"), "<u4")
    gap = c == 0
    n = at
    h = c * np.uint32(0x9E3779B1)
    out = []
    for order in (1, 2, 3):
        if order > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[order - 1 :] * np.uint32(0x9E3779B1)
        bad = gap[:n].copy()
        for k in range(1, order):
            bad |= gap[k : n + k]
        x = ((h[:n] ^ (h[:n] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) >> np.uint32(17)).astype(np.int64)
        x[bad] = DIMS
        out.append(x)
    return out, np.array(starts, np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    values: np.ndarray  # (DIMS + 1, languages): idf times weight, zero in the last row
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> np.ndarray:
        hashes, starts = ngrams(texts)
        total = np.zeros((len(texts), len(self.languages)))
        number = np.zeros(len(texts))
        for x in hashes:
            total += np.add.reduceat(self.values[x], starts, axis=0)
            number += np.add.reduceat((x < DIMS).astype(np.int64), starts)
        return SCALE * total / np.maximum(number, 1)[:, None] + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not texts:
            return [], np.zeros(0)
        blank = np.array([_LETTER.search(t) is None for t in texts])
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        z = self.logits(texts) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        names = [UNDETERMINED if b else self.languages[i] for b, i in zip(blank, best)]
        return names, np.where(blank, 0.0, p[np.arange(len(texts)), best])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, *, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIMS, k) and biases by FTRL-proximal with an elastic net, row by row."""
    z, n = np.zeros((DIMS + 1, k)), np.zeros((DIMS + 1, k))

    def weights(i):
        zi, ni = z[i], n[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, x = rows[r]
            at, x = np.r_[at, DIMS], np.r_[x, 1.0]  # the last one is the bias
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[r]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(DIMS + 1))
    return w[:DIMS], w[DIMS]


def train(docs: DataFrame, *, rows_per_language: int = 800, most_languages: int = 500) -> LanguageModel:
    """Fit on documents that have a language, a doc_id and are not held out.

    Document frequencies cover all of them, the weights about ``rows_per_language`` different
    ids per language (a share by hash of doc_id).  The ``most_languages`` values of ``lang``
    with most ids are learned, which bounds the model.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & (crc32_mod5() != 0))

    def frequencies(batches):
        total = np.zeros(DIMS + 2, np.int64)
        for batch in slices(batches, most=NGRAM_BYTES):
            texts = texts_of(batch)
            hashes, starts = ngrams(texts)
            ends = np.r_[starts[1:], hashes[0].size]
            for a, b in zip(starts, ends):
                seen = np.zeros(DIMS + 1, bool)
                for x in hashes:
                    seen[x[a:b]] = True
                total[: DIMS + 1] += seen
            total[DIMS + 1] += len(texts)
        yield vector_blocks(total)

    counts = sum_vectors(known.select("text").mapInArrow(frequencies, "block int, data binary"), DIMS + 2, kind="<i8")
    idf = np.log((1 + counts[-1]) / (1 + counts[:DIMS])) + 1
    chosen = sampled_rows(known, rows_per_language, "languages", by="lang", most=most_languages)

    def vectors(batches):
        for batch in slices(batches, most=NGRAM_BYTES):
            hashes, starts = ngrams(texts_of(batch))
            ends = np.r_[starts[1:], hashes[0].size]
            at, n = [], []
            for a, b in zip(starts, ends):
                u, c = np.unique(np.concatenate([x[a:b] for x in hashes]), return_counts=True)
                at.append(u[u < DIMS].astype("<u2").tobytes())
                n.append((c[u < DIMS] / max(1, c[u < DIMS].sum())).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["doc_id", "lang", "at", "share"])

    rows = sorted(chosen.mapInArrow(vectors, "doc_id long, lang string, at binary, share binary").collect(), key=lambda r: (r["doc_id"], r["lang"]))
    names = sorted({r["lang"] for r in rows})
    if not rows:
        return LanguageModel([], np.zeros((DIMS + 1, 0)), np.zeros(0))
    y = np.array([names.index(r["lang"]) for r in rows])
    x = []
    for r in rows:
        at = np.frombuffer(r["at"], "<u2").astype(np.int64)
        x.append((at, np.frombuffer(r["share"], "<f4") * idf[at] * SCALE))
    aside = np.arange(len(rows)) % 8 == 7
    fit = np.flatnonzero(~aside)
    weights, bias = ftrl([x[i] for i in fit], y[fit], len(names))
    values = np.zeros((DIMS + 1, len(names)), np.float32)
    values[:DIMS] = idf[:, None] * weights
    model = LanguageModel(names, values, bias)
    check = np.flatnonzero(aside) if aside.any() else fit
    logits = np.stack([x[i][1] @ weights[x[i][0]] + bias for i in check])

    def loss(t):
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return -(z[np.arange(len(check)), y[check]] - np.log(np.exp(z).sum(axis=1))).mean()

    model.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs``."""

    def run(batches):
        for batch in slices(batches, most=NGRAM_BYTES):
            names, p = model.predict(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(p, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of ``docs``.

    A null text or one without a letter is ``und`` with score 0, as is everything if there is
    nothing to learn from.  A null doc_id is not held out and not learned from.  Rows that
    repeat a doc_id are predicted each by itself and learned from once per language (the
    least of their texts); of languages equally likely the first by name is given.  Whole
    texts of any length count; an empty table gives an empty result; other columns are left out.
    """
    out = identify(docs, train(docs, **how))
    return out.select("doc_id", F.coalesce(crc32_mod5() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
