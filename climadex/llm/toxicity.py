"""Toxicity by weak supervision.

Voters come from two places: fixed patterns, and a lexicon of words and word starts that
are over-represented in toxic training documents, near copies counted once (hashed counts first, then the exact
strings of the chosen hash buckets).  A generative label model is fitted to their votes
without labels: expectation-maximisation estimates how often each voter fires on toxic and
on clean documents, and voters whose votes stay correlated given the label share their
weight.  Its posterior labels train a logistic regression over the voters' counts, whose
bias is set on the training labels.  Every document is then scored over its whole text.

Only rows whose crc32(doc_id as text) mod 5 is not 0 are learned from, at most
``train_rows`` of them (a share by hash of doc_id, stored once); the held-out share stays unseen.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_mod5, hash_below, plain_names, slices, stored, sum_vectors, texts_of, vector_blocks
from .simhash import near_duplicates

_WORD = re.compile(r"\w+")
#: Lengths of the word starts that may vote: stems of inflected insults.
STARTS = (4, 5, 6, 7, 8)
BUCKETS = 1 << 20

#: Fixed patterns, voters of their own.
PATTERNS = [
    ("insult_you", re.compile(r"\byou(?:'re| are)? (?:an? )?(?:\w+ )?(?:idiot|moron|loser|scum|trash|clown|fool|stupid|pathetic|worthless)\b")),
    ("shut_up", re.compile(r"\bshut (?:the \w+ )?up\b")),
    ("go_die", re.compile(r"\b(?:go die|kill yourself|drop dead)\b")),
    ("hate", re.compile(r"\bi (?:\w+ )?(?:hate|despise) (?:you|them|those)\b")),
    ("insult", re.compile(r"\b(?:idiots?|morons?|losers?|imbeciles?|dumbass\w*|bastards?|assholes?|bitch\w*|fuck\w*|shit\w*)\b")),
]


def features(text: str) -> dict[str, int]:
    """Counts of the words and word starts of a lower-cased text."""
    out: dict[str, int] = {}
    for w in _WORD.findall(text.lower()):
        out[w] = out.get(w, 0) + 1
    for w, n in list(out.items()):
        for k in STARTS:
            if len(w) > k:
                s = f"^{w[:k]}"
                out[s] = out.get(s, 0) + n
    return out


def _bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def _strength(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Log-likelihood ratio of firing more in toxic than in clean documents.

    0 for what fires less than nine times as often there.
    """
    n = toxic + clean
    share = n_toxic / (n_toxic + n_clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (toxic * np.log(toxic / (n * share)) + np.where(clean > 0, clean * np.log(clean / (n * (1 - share))), 0))
    return np.where((toxic > 0) & (toxic / n_toxic >= 9 * clean / n_clean), g, 0.0)


#: Voters are stronger than this; thousands of features are tried.
STRONG = 30.0


@dataclass
class ToxicityModel:
    lexicon: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.full(len(PATTERNS) + 1, 1.0))
    bias: float = -1.5
    n_train: int = 0

    def __post_init__(self):
        self._at = {f: i for i, f in enumerate(self.lexicon)}
        self._words = {f for f in self.lexicon if f[0] != "^"}
        self._starts = {k: {f[1:] for f in self.lexicon if f[0] == "^" and len(f) == k + 1} for k in STARTS}

    def votes(self, text: str) -> dict[int, int]:
        """Counts by voter; the last voter stands for two or more different lexicon hits."""
        out: dict[int, int] = {}
        text = text.lower()
        kinds = set()
        words = _WORD.findall(text)
        starts = [(k, s) for k, s in self._starts.items() if s]
        known = self._words
        for w in words:
            if w in known:
                i = self._at[w]
                out[i] = out.get(i, 0) + 1
                kinds.add(w)
            for k, s in starts:
                if len(w) > k and w[:k] in s:
                    i = self._at[f"^{w[:k]}"]
                    out[i] = out.get(i, 0) + 1
                    kinds.add(w)
        n = len(self.lexicon)
        for j, (_, p) in enumerate(PATTERNS):
            if c := sum(1 for _ in p.finditer(text)):
                out[n + j] = c
        if len(kinds) > 1:
            out[n + len(PATTERNS)] = len(kinds)
        return out

    def raw(self, votes: dict[int, int]) -> float:
        return self.bias + sum(self.weights[i] * math.log1p(c) for i, c in votes.items())

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.raw(self.votes(text))))))


def label_model(fires: np.ndarray, prior: float, start: np.ndarray, rounds: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the label, and each voter's share after correlations.

    ``fires`` is (documents, voters) of 0 and 1; ``start`` the first guess of the posterior.
    """
    post, share = start, np.ones(fires.shape[1])
    for r in range(rounds):
        n1, n0 = post.sum(), (1 - post).sum()
        a = np.clip((post @ fires + 0.1) / (n1 + 1), 1e-4, 0.9999)
        b = np.clip(((1 - post) @ fires + 0.1) / (n0 + 1), 1e-4, 0.9999)
        if r % 5 == 4:
            # Votes that still go together given the label count once between them.
            rest = fires - post[:, None] * a - (1 - post)[:, None] * b
            cov = rest.T @ rest
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = cov / sd[:, None] / sd
            np.fill_diagonal(corr, 0)
            share = 1 / (1 + np.where(corr > 0.2, corr, 0).sum(axis=1))
        log = math.log(prior / (1 - prior)) + fires @ (share * np.log(a / b)) + (1 - fires) @ (share * np.log((1 - a) / (1 - b)))
        new = 1 / (1 + np.exp(-np.clip(log, -40, 40)))
        if np.abs(new - post).max() < 1e-5 and r > 12:
            break
        post = new
    return post, share


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 400, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Adagrad on the log-loss of soft labels."""
    w, b = np.zeros(x.shape[1]), -1.0
    gw, gb = np.full(x.shape[1], 1e-6), 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40)))
        d = (p - y) / len(y)
        g = x.T @ d + l2 * w
        gw += g * g
        gb += d.sum() ** 2
        w -= rate * g / np.sqrt(gw)
        b -= rate * d.sum() / math.sqrt(gb)
    return w, float(b)


def _broad(fires: np.ndarray) -> list[int]:
    """Voters worth keeping, of (toxic documents, voters).

    Words that a group of copies has by chance fire where much broader voters do; what nine
    tenths of its firings share with voters three times as broad is left out.
    """
    support = fires.sum(axis=0)
    kept: list[int] = []
    for j in np.argsort(-support, kind="stable"):
        wider = [k for k in kept if support[k] >= 3 * support[j]]
        if not wider or fires[np.ix_(fires[:, j], wider)].any(axis=1).mean() < 0.9:
            kept.append(int(j))
    return sorted(kept)


def _unnested(features: list[str]) -> list[str]:
    """Of features in the order of their strength, those that add firings to the ones before them.

    A word, or a longer start, fires only where a start that it begins with does; of a word and
    a start of it the stronger one stands for both.
    """
    kept: list[str] = []
    for f in features:
        own = f.removeprefix("^")
        if not any(own.startswith(k) if g else k.startswith(own) if f[0] == "^" else False for k, g in ((x.removeprefix("^"), x[0] == "^") for x in kept)):
            kept.append(f)
    return kept


def train(docs: DataFrame, labels: DataFrame, *, train_rows: int = 20_000, voters: int = 400) -> ToxicityModel:
    """Fit on at most ``train_rows`` labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(crc32_mod5() != 0)
    # About train_rows of them by hash, no more than train_rows: a task sorts its share of these alone.
    few = known.where(hash_below(train_rows / max(1, known.count()), "doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # The one scan of all texts; rows that repeat an id are merged, so the sample keeps its bound.
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    chosen = stored(chosen.select("doc_id", "text", "toxic"), "labelled")

    # Copies and near copies of a text count once, or a large group of them would fill the
    # lexicon with its words: one text for each class and label.
    classes = near_duplicates(chosen).select("doc_id", F.col("component_id").alias("class"))
    distinct = stored(chosen.join(F.broadcast(classes), "doc_id").groupBy("class", "toxic").agg(F.min("text").alias("text")), "distinct")

    def count(batches):
        # Toxic and clean document frequencies by bucket, then the two numbers of documents.
        total = np.zeros(2 * BUCKETS + 2, np.int32)
        for batch in slices(batches):
            for text, y in zip(texts_of(batch), batch.column("toxic").to_pylist()):
                at = np.unique(np.fromiter(map(_bucket, features(text)), np.int64))
                total[at + (0 if y else BUCKETS)] += 1
                total[2 * BUCKETS + (0 if y else 1)] += 1
        yield vector_blocks(total)

    counts = sum_vectors(distinct.mapInArrow(count, "block int, data binary"), 2 * BUCKETS + 2, kind="<i4").astype(float)
    n_toxic, n_clean = counts[-2:]
    if not n_toxic or not n_clean:
        return ToxicityModel()
    least = max(3.0, 0.002 * n_toxic)
    z = _strength(counts[:BUCKETS], counts[BUCKETS:-2], n_toxic, n_clean)
    z[counts[:BUCKETS] < least] = 0
    top = np.argsort(-z)[: 3 * voters]
    picked = np.zeros(BUCKETS, bool)
    picked[top[z[top] > STRONG / 2]] = True  # other strings may share the bucket

    def exact(batches):
        seen: dict[str, list[int]] = {}
        for batch in slices(batches):
            for text, y in zip(texts_of(batch), batch.column("toxic").to_pylist()):
                for f in features(text):
                    if picked[_bucket(f)]:
                        seen.setdefault(f, [0, 0])[0 if y else 1] += 1
        names = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[f][0] for f in names], pa.int64()), pa.array([seen[f][1] for f in names], pa.int64())], ["feature", "toxic", "clean"])

    # At most 3 * voters buckets, each with few features of that support.
    found = distinct.mapInArrow(exact, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") >= least).collect()
    if not found:
        return ToxicityModel()
    t, c = (np.array([r[k] for r in found], float) for k in ("t", "c"))
    z = _strength(t, c, n_toxic, n_clean)
    names = [r["feature"] for r in found]
    strong = _unnested([names[i] for i in np.lexsort((names, [-len(f) for f in names], -z)) if z[i] > STRONG])
    model = ToxicityModel(lexicon=sorted(strong[:voters]))

    def cast(model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
        """Votes and labels of the training rows, at most ``train_rows`` short rows."""

        def vote(batches):
            for batch in slices(batches):
                got = [model.votes(x) for x in texts_of(batch)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([list(v) for v in got], pa.list_(pa.int32())), pa.array([list(v.values()) for v in got], pa.list_(pa.int32()))], ["doc_id", "toxic", "at", "n"])

        rows = sorted(chosen.mapInArrow(vote, "doc_id long, toxic int, at array<int>, n array<int>").collect(), key=lambda r: r["doc_id"])
        x = np.zeros((len(rows), len(model.lexicon) + len(PATTERNS) + 1))
        for i, r in enumerate(rows):
            x[i, r["at"]] = np.log1p(r["n"])
        return x, np.array([r["toxic"] for r in rows])

    x, y = cast(model)
    model = ToxicityModel(lexicon=[model.lexicon[i] for i in _broad(x[y == 1, : len(model.lexicon)] > 0)])
    x, y = cast(model)
    fires = (x > 0).astype(float)
    prior = min(0.9, max(0.01, float(y.mean())))
    post, _ = label_model(fires, prior, np.clip(fires.sum(axis=1) / 2, 0.02, 0.98))
    w, b = _logistic(x, post)
    # The bias that labels the training rows best; in the middle of the gap if many do.
    raw = x @ w
    order = np.argsort(raw, kind="stable")
    right = np.cumsum(np.r_[y.sum(), np.where(y[order] == 1, -1, 1)])
    can = np.r_[True, raw[order][1:] > raw[order][:-1] + 1e-9, True]
    best = int(np.flatnonzero(can)[right[can].argmax()])
    low = raw[order][best - 1] if best else raw.min() - 1
    high = raw[order][best] if best < len(raw) else raw.max() + 1
    model.weights, model.bias, model.n_train = w, -float((low + high) / 2), len(y)
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of each row of ``docs``; a null text is scored as an empty one."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.score(t) for t in texts_of(batch)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``.

    Labels with a null doc_id or a null mark are not used; if several rows label a document,
    the worse mark counts.  Without any usable label of either kind the fixed patterns alone
    decide.  A null doc_id is not held out.  Rows that repeat a doc_id are scored each by
    itself and learned from once (the least of their texts).  Whole texts of any length are
    scored; an empty table gives an empty result.  Other columns are left out.
    """
    out = score(docs, train(docs, labels, **how))
    return out.select("doc_id", F.coalesce(crc32_mod5() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns, in one scan.

    Each row is judged by itself: null or empty texts, rows without an id and repeated rows
    stay or go by their own score.
    """
    model = train(docs, labels, **how)
    docs, named = plain_names(docs)

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array([model.score(t) < 0.5 for t in texts_of(batch)]))

    return named(docs.mapInArrow(run, T.StructType(docs.schema.fields)))
