"""Benchmark decontamination by latent semantic retrieval.

1. Every text becomes a row of 32-bit word hashes, written once; inverse document
   frequencies of hashed words are counted over the passages of all documents.
2. A randomised range finder gives the leading right singular vectors of the TF-IDF
   matrix of passages: each task multiplies its rows a by a shared random matrix and sums
   a (a' R); the sum A'A R and a Nystrom step give singular vectors and values.  It is
   fitted once, on the passages of all documents and of all items of the benchmark; every
   passage is projected with it.
3. Overlapping windows of all documents are projected to the whitened latent space and
   compared with the benchmark's passages by cosine: matrix products in blocks.  The items
   lie in the shared folder in blocks of a bounded number of passages; a task takes one
   block after the other for a slice of its documents, in one scan of them.
4. Next to these neighbours, an index of each item's rarest words gives every place of about
   the item's length that can hold enough of its words (see ``WordIndex``).
5. Each candidate is verified on the words: the longest common subsequence of the item and
   the place of the window must cover most of the item, or half of it together with its
   answer (its last words), which catches paraphrases.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import planned_bytes, shared_dir, slices, stored, sum_vectors, texts_of, vector_blocks, without_ids
from .token_files import file_system

_WORD = re.compile(r"\w+")
FEATURES = 1 << 15
#: Words of a window; windows start at every half of it.
WINDOW = 24
HALF = WINDOW // 2
SKETCH, LATENT = 96, 80
SEED = 11
#: Passages in a block of items; an item of more is a block of its own.
BLOCK_PASSAGES = 4096
#: Items of fewer words are searched by their exact words only.
SHORT = 6
#: Of items up to so many words, half a copy with the answer occurs by chance: the word index
#: asks for a whole one.
BRIEF = 12
_CACHE_WORDS = 600_000
#: Latin-1 bytes that ``\w`` matches, all others as blanks.
_WORD_BYTES = bytes(b if chr(b).isalnum() or b == 95 else 32 for b in range(256))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh32_intdigest(word)
        return h


_known = _Hashes()


def word_hashes(text: str) -> np.ndarray:
    """32-bit hashes of the lower-cased words, punctuation and layout left out.

    A word is hashed as Latin-1 where it has only such characters, as UTF-8 otherwise; a
    Latin-1 text is cut as bytes.
    """
    if len(_known) > _CACHE_WORDS:
        _known.clear()
    text = text.lower()
    try:
        words = text.encode("latin-1").translate(_WORD_BYTES).split(b" ")
        words = [w for w in words if w]
    except UnicodeEncodeError:
        words = []
        for w in _WORD.findall(text):
            try:
                words.append(w.encode("latin-1"))
            except UnicodeEncodeError:
                words.append(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(_known.__getitem__, words), np.uint32, len(words))


def _features(words: np.ndarray) -> np.ndarray:
    return (words * np.uint32(0x9E3779B1)) >> np.uint32(17)


#: Half windows projected at a time.
CHUNK = 4096


@dataclass
class Latent:
    """A map from words to the whitened latent space."""

    idf: np.ndarray
    basis: np.ndarray  # (FEATURES + 1, LATENT): idf times singular vector over singular value, then zeros

    def windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of the windows at words 0, HALF, 2 HALF, ... of all texts; text and word of each.

        A text of HALF words or fewer has one window; otherwise the last one ends with the text.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        halves = -(-sizes // HALF)
        first = np.r_[0, np.cumsum(halves)[:-1]] if len(texts) else sizes
        features = np.full(int(halves.sum()) * HALF, FEATURES, np.int64)
        if sizes.sum():
            at = np.arange(sizes.sum()) + np.repeat(first * HALF - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
            features[at] = _features(np.concatenate(texts))
        sums = np.empty((len(features) // HALF, self.basis.shape[1]), np.float32)
        ones = np.ones(HALF, np.float32)
        for i in range(0, len(sums), CHUNK):
            rows = np.take(self.basis, features[i * HALF : (i + CHUNK) * HALF], axis=0)
            sums[i : i + CHUNK] = ones @ rows.reshape(-1, HALF, self.basis.shape[1])
        text = np.repeat(np.arange(len(texts)), halves)
        word = (np.arange(len(sums)) - np.repeat(first, halves)) * HALF
        if len(sums) > 1:
            joined = text[1:] == text[:-1]
            sums[:-1][joined] += sums[1:][joined]
        keep = (word + HALF < sizes[text]) | (word == 0)
        sums, text, word = sums[keep], text[keep], word[keep]
        return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9), text, word


def _bits(item: np.ndarray) -> dict[int, int]:
    """Places of each word of the item, as bits."""
    bits: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        bits[w] = bits.get(w, 0) | 1 << i
    return bits


def _lcs(m: int, found: list[int]) -> int:
    """Longest common subsequence of an item of m words and the words of a place that it has, as their bits."""
    full = (1 << m) - 1
    v = full
    for b in found:
        u = v & b
        v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def lcs_length(item: np.ndarray, place: np.ndarray) -> int:
    """Longest common subsequence, bit-parallel over the item."""
    return _lcs(len(item), [b for b in map(_bits(item).get, place.tolist()) if b])


class Verifier:
    """Decides whether places hold an item.

    The answer is the last quarter of the item's words, three at least.
    """

    def __init__(self, item: np.ndarray, *, cover: float, least: float, answer_cover: float):
        self.n, self.bits = len(item), _bits(item)
        self.words = frozenset(self.bits)
        self.n_answer = min(self.n, max(3, self.n // 4))
        self.cover, self.least, self.answer_cover = cover, least, answer_cover

    def share(self, place: list[int]) -> float | None:
        """Share of the item found at the place in order, None if that is no leak."""
        return self.share_of([b for b in map(self.bits.get, place) if b])

    def share_of(self, found: list[int]) -> float | None:
        """The same of the bits of the place's words that the item has."""
        # The subsequence is no longer than the words it can be made of.
        if len(found) < min(self.cover, self.least) * self.n:
            return None
        share = _lcs(self.n, found) / self.n
        if share >= self.cover:
            return share
        if share >= self.least:
            rest = self.n - self.n_answer
            if _lcs(self.n_answer, [b >> rest for b in found]) >= self.answer_cover * self.n_answer:
                return share
        return None


def span(n: int) -> int:
    """Words of the places in which the word index looks for an item of n words."""
    return n + min(n, 2 * HALF)


#: Words that are taken for one text of the word index, and hits of it in memory at a time.
PIECE, HITS = 1 << 16, 1 << 21


class WordIndex:
    """Places of texts that hold enough words of an item, none left out.

    A place with t of an item's n words has at least k of its n - t + k rarest; such
    words are looked up, and k of them within ``span(n)`` words make a candidate.
    """

    RAREST = 4

    def __init__(self, items: list[np.ndarray], checks: list[Verifier], idf: np.ndarray):
        self.checks, self.spans, self.most = checks, np.array([span(len(w)) for w in items], np.int64), max((span(len(w)) for w in items), default=1)
        self.need = np.ones(len(items), np.int64)
        self.least = [0] * len(items)
        postings: dict[int, list[int]] = {}
        for i, w in enumerate(items):
            if len(w) < SHORT:
                continue
            t = max(1, int(np.ceil(min(checks[i].cover, checks[i].least) * len(w) - 1e-9)))
            self.least[i] = t
            if t > len(w):
                continue
            self.need[i] = k = min(self.RAREST, t)
            rare = np.lexsort((w, -idf[_features(w)]))[: len(w) - t + k]
            for x in set(w[rare].tolist()):
                postings.setdefault(x, []).append(i)
        self.words = np.array(sorted(postings), np.uint32)
        self.sizes = np.array([len(postings[x]) for x in self.words.tolist()], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.items = np.array([i for x in self.words.tolist() for i in postings[x]], np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.words >> np.uint32(12)] = True

    def regions(self, texts: list[np.ndarray]):
        """(text, item, first word, last word) of regions whose places may hold the item."""
        if not self.words.size:
            return
        held, hits = [], 0
        for t, w in enumerate(texts):
            for a in range(0, max(1, len(w) - self.most), PIECE):
                piece = w[a : a + PIECE + self.most]
                at = np.flatnonzero(self.maybe[piece >> np.uint32(12)])
                j = np.minimum(np.searchsorted(self.words, piece[at]), len(self.words) - 1)
                good = self.words[j] == piece[at]
                at, j = at[good], j[good]
                if at.size:
                    held.append((t, a, len(piece), at, j))
                    hits += int(self.sizes[j].sum())
                if hits > HITS:
                    yield from self._merged(held)
                    held, hits = [], 0
        if held:
            yield from self._merged(held)

    def _merged(self, held):
        # Texts stand apart by more than any span, and so do items.
        sizes = np.array([h[2] for h in held], np.int64) + self.most
        start = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        at = np.concatenate([h[3] + s for h, s in zip(held, start)])
        j = np.concatenate([h[4] for h in held])
        rep = self.sizes[j]
        item = self.items[np.repeat(self.first[j] - (np.cumsum(rep) - rep), rep) + np.arange(int(rep.sum()))]
        key = item * n + np.repeat(at, rep)
        key.sort()
        item = key // n
        end = np.arange(key.size) + self.need[item] - 1
        last = key[np.minimum(end, key.size - 1)]
        good = (end < key.size) & (last - key < self.spans[item])
        key, last, item = key[good], last[good], item[good]
        text = np.searchsorted(start, key - item * n, side="right") - 1
        low, high = last - item * n - self.spans[item] + 1 - start[text], key - item * n + self.spans[item] - start[text]
        cut = np.ones(key.size, bool)
        cut[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (low[1:] > high[:-1])
        begin = np.flatnonzero(cut)
        stop = np.r_[begin[1:], key.size] - 1 if key.size else begin
        for x, i, a, b in zip(text[begin].tolist(), item[begin].tolist(), low[begin].tolist(), high[stop].tolist()):
            t, base, size, _, _ = held[x]
            yield t, i, base + max(0, a), base + min(size, b)

    def best(self, i: int, text: list[int], a: int, b: int) -> tuple[float, int, int] | None:
        """Largest share of the item in a place between a and b, with the place."""
        check, t, width, out = self.checks[i], self.least[i], int(self.spans[i]), None
        bits, n = check.bits, check.n
        place = text[a:b]
        # No more of the item's words than stand anywhere in between, and no longer in order.
        if sum(bits[w].bit_count() for w in check.words.intersection(place)) < t:
            return None
        at = [p for p, w in enumerate(place, a) if w in bits]
        found = [bits[text[p]] for p in at]
        if _lcs(n, found) < t:
            return None
        # A place may as well start with its first word of the item.
        for x, p in enumerate(at[: len(at) - t + 1]):
            if at[x + t - 1] - p < width:
                share = check.share_of(found[x : bisect_left(at, p + width)])
                if share is not None and (out is None or share > out[0]):
                    out = (share, p, min(p + width, len(text)))
                    if share == 1:
                        break
        return out


def _passages(words: np.ndarray) -> list[int]:
    """Starts of an item's passages: every WINDOW words, the last one flush with the end."""
    starts = list(range(0, max(1, len(words) - WINDOW + 1), WINDOW))
    if len(words) > WINDOW and starts[-1] + WINDOW < len(words):
        starts.append(len(words) - WINDOW)
    return starts


#: Words of a text that are taken for one of the fit, and passages sketched at a time (their
#: numbers and features are sorted as 32 bits).
GRAM_WORDS, GRAM_PASSAGES = WINDOW << 10, 1 << 15
#: Rows that ``run_sums`` adds by one product.
RUN = 32


def run_sums(rows: np.ndarray, order: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of ``rows[order]`` over consecutive runs of n rows each, one at least.

    Runs are cut into groups of RUN and a rest; groups of the same size are added together,
    then the sums of the groups of each run.
    """
    groups = -(-n // RUN)
    at = np.arange(int(groups.sum())) - np.repeat(np.cumsum(groups) - groups, groups)
    first = np.repeat(np.cumsum(n) - n, groups) + at * RUN
    size = np.minimum(np.repeat(n, groups) - at * RUN, RUN)
    out = np.empty((len(first), rows.shape[1]), rows.dtype)
    for r in range(1, RUN + 1):
        same, ones = np.flatnonzero(size == r), np.ones(r, rows.dtype)
        for i in range(0, len(same), 64):
            g = same[i : i + 64]
            if r < 8:  # too small for a product each
                part = np.take(rows, order[first[g]], axis=0)
                for k in range(1, r):
                    part += np.take(rows, order[first[g] + k], axis=0)
            else:
                part = ones @ np.take(rows, order[first[g, None] + np.arange(r)], axis=0)
            out[g] = part
    return out if groups.max(initial=1) == 1 else run_sums(out, np.arange(len(out)), groups)


def fit(words: DataFrame, items: DataFrame) -> Latent:
    """The latent space of all documents (doc_id, words) and all items (item_id, words)."""

    def frequencies(batches):
        total = np.zeros(FEATURES + 1, np.int64)
        for batch in slices(batches, "words"):
            texts = [np.frombuffer(raw, "<u4") for raw in batch.column("words").to_pylist()]
            sizes = np.array([t.size for t in texts])
            passages = -(-sizes // WINDOW)
            f = _features(np.concatenate(texts)).astype(np.int64)
            inside = np.arange(f.size) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)
            p = inside // WINDOW + np.repeat(np.r_[0, np.cumsum(passages)[:-1]], sizes)
            keys = p * FEATURES + f
            keys = np.sort(keys.astype(np.uint32) if p.size and p[-1] < 1 << 17 else keys)
            once = keys[np.r_[True, keys[1:] != keys[:-1]]] if keys.size else keys
            total[:FEATURES] += np.bincount((once % FEATURES).astype(np.int64), minlength=FEATURES)
            total[FEATURES] += passages.sum()
        yield vector_blocks(total)

    counts = sum_vectors(words.select("words").mapInArrow(frequencies, "block int, data binary"), FEATURES + 1, kind="<i8")
    idf = (np.log((1 + counts[-1]) / (1 + counts[:FEATURES])) + 0.1).astype(np.float32)
    sketch = np.random.default_rng(SEED).standard_normal((FEATURES, SKETCH)).astype(np.float32)

    weighted = np.vstack([idf[:, None] * sketch, np.zeros((1, SKETCH), np.float32)])

    def gram(texts: list[np.ndarray], total: np.ndarray) -> None:
        """Add the sum of a (a' sketch) over unit TF-IDF passages a, short of the left a's idf."""
        sizes = np.array([t.size for t in texts])
        passages = -(-sizes // WINDOW)
        f = np.full(int(passages.sum()) * WINDOW, FEATURES, np.uint16)
        shift = (np.cumsum(passages) - passages) * WINDOW - (np.cumsum(sizes) - sizes)
        f[np.arange(int(sizes.sum())) + np.repeat(shift, sizes)] = _features(np.concatenate(texts))
        # Repeats of a word in a passage add up in a; its norm is that of the sums.
        keys = np.repeat(np.arange(f.size // WINDOW, dtype=np.uint32) << np.uint32(16), WINDOW) | f
        keys.sort()
        once = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        n, key = np.diff(np.r_[once, keys.size]), keys[once]
        square = np.bincount(key >> np.uint32(16), (n * np.append(idf, 0)[key & np.uint32(0xFFFF)]) ** 2)
        rows = np.empty((f.size // WINDOW, SKETCH), np.float32)
        ones = np.ones(WINDOW, np.float32)
        for i in range(0, len(rows), 64):
            rows[i : i + 64] = ones @ np.take(weighted, f[i * WINDOW : (i + 64) * WINDOW], axis=0).reshape(-1, WINDOW, SKETCH)
        rows /= square.astype(np.float32)[:, None]
        counts = np.bincount(f, minlength=FEATURES)[:FEATURES]
        order = np.argsort(f, kind="stable")[: counts.sum()] // WINDOW
        have = np.flatnonzero(counts)
        total[have] += run_sums(rows, order, counts[have])

    def sums(batches):
        total = np.zeros((FEATURES, SKETCH))
        held, n = [], 0
        for batch in slices(batches, "words"):
            for t in (np.frombuffer(raw, "<u4") for raw in batch.column("words").to_pylist()):
                for i in range(0, t.size, GRAM_WORDS):
                    held.append(t[i : i + GRAM_WORDS])
                    n += -(-held[-1].size // WINDOW)
                    if n >= GRAM_PASSAGES:
                        gram(held, total)
                        held, n = [], 0
        if held:
            gram(held, total)
        yield vector_blocks((total * idf[:, None]).astype(np.float32).reshape(-1))

    both = words.select("words").unionByName(items.select("words"))
    both = both.coalesce(16 + planned_bytes(both) // (64 << 20))  # a task sends FEATURES x SKETCH numbers
    y = sum_vectors(both.mapInArrow(sums, "block int, data binary"), FEATURES * SKETCH, kind="<f4").reshape(FEATURES, SKETCH).astype(np.float64)
    # Nystrom: A'A is about y (R'y)^+ y', with R the sketch.
    core = sketch.T.astype(np.float64) @ y
    core = (core + core.T) / 2
    value, vector = np.linalg.eigh(core)
    good = value > value.max(initial=0) * 1e-7
    half = y @ (vector[:, good] / np.sqrt(value[good]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    k = min(LATENT, int((s > s.max(initial=0) * 1e-5).sum()))
    basis = (idf[:, None] * u[:, :k] / np.maximum(s[:k], 1e-12)).astype(np.float32)
    basis /= max(float(np.abs(basis).max(initial=0)), 1e-12)
    return Latent(idf, np.vstack([basis, np.zeros((1, k), np.float32)]))


class Block:
    """Some items with what a search for them needs."""

    def __init__(self, ids: list[int], items: list[np.ndarray], latent: Latent, *, cover: float, least: float, answer_cover: float):
        self.ids, self.lengths = ids, [len(w) for w in items]
        self.short: dict[bytes, list[int]] = {}
        for i, w in zip(ids, items):
            if 0 < len(w) < SHORT:
                self.short.setdefault(w.tobytes(), []).append(i)
        self.sizes = sorted({len(k) // 4 for k in self.short})
        self.spots = [(i, s) for i, w in enumerate(items) if len(w) >= SHORT for s in _passages(w)]
        # A passage has one window: the first one of its own words.
        probe, _, word = latent.windows([items[i][s : s + WINDOW] for i, s in self.spots])
        self.probe = probe[word == 0]
        self.spot_item, self.spot_start = (np.array([x[k] for x in self.spots], np.int64) for k in (0, 1))
        self.n = np.array(self.lengths, np.int64)
        # Each item's words as marks in a table of its own; words of others may share a mark.
        self.mask = np.array([(1 << (16 * n).bit_length()) - 1 for n in self.lengths], np.int64)
        self.first = np.cumsum(self.mask + 1) - self.mask - 1
        self.marks = np.zeros(int((self.mask + 1).sum()), np.uint8)
        for w, m, f in zip(items, self.mask, self.first):
            self.marks[f + (w & m)] = 1
        self.least = min(cover, least)
        how = {"cover": cover, "answer_cover": answer_cover}
        self.checks = [Verifier(w, least=least, **how) for w in items]
        self.index = WordIndex(items, [Verifier(w, least=cover, **how) if len(w) <= BRIEF else c for w, c in zip(items, self.checks)], latent.idf)

    def _enough(self, words: np.ndarray, at: np.ndarray, sizes: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which places can be a leak by the number of their words that the item has.

        A bound of the subsequence, so no place is lost that ``Verifier`` would take.
        """
        good = np.zeros(len(at), bool)
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(HITS, int(sizes.sum()) + HITS, HITS), "right")
        for x, y in zip(np.r_[0, cuts], np.r_[cuts, len(at)]):
            if x < y:
                n, i = sizes[x:y], item[x:y]
                first = np.cumsum(n) - n
                place = np.take(words, np.arange(int(n.sum())) + np.repeat(at[x:y] - first, n)).astype(np.int64)
                marks = np.take(self.marks, (place & np.repeat(self.mask[i], n)) + np.repeat(self.first[i], n))
                found = np.add.reduceat(marks.astype(np.int32), np.minimum(first, len(marks) - 1)) if len(marks) else np.zeros(len(n))
                good[x:y] = (n > 0) & (found >= self.least * self.n[i])
        return good

    def search(self, texts: list[np.ndarray], lists: list[list[int]], windows, cosine: float, word_index: bool):
        """(text, item_id, share, first word, last word) of the items found, the best place of each."""
        vectors, text, word = windows
        best: dict[tuple[int, int], tuple] = {}
        sizes = np.array([len(t) for t in texts], np.int64)
        start, joined = np.cumsum(sizes) - sizes, np.concatenate(texts)
        for k in range(0, len(vectors), CHUNK):
            for p in range(0, len(self.probe), BLOCK_PASSAGES):
                probe = self.probe[p : p + BLOCK_PASSAGES]
                near = vectors[k : k + CHUNK] @ probe.T
                r, c = np.divmod(np.flatnonzero(near >= cosine), len(probe))
                d, i = text[k + r], self.spot_item[p + c]
                a = np.maximum(word[k + r] - self.spot_start[p + c] - HALF, 0)
                # Several passages of an item lead to the same place.
                _, once = np.unique((d * len(self.n) + i) * (int(sizes.max()) + 1) + a, return_index=True)
                d, i, a = d[once], i[once], a[once]
                b = np.minimum(sizes[d], a + np.maximum(self.n[i], WINDOW) + 2 * HALF)
                good = self._enough(joined, start[d] + a, b - a, i)
                for d, i, a, b in zip(d[good].tolist(), i[good].tolist(), a[good].tolist(), b[good].tolist()):
                    if best.get((d, i), (0,))[0] == 1:
                        continue
                    share = self.checks[i].share(lists[d][a:b])
                    if share is not None and share > best.get((d, i), (0,))[0]:
                        best[d, i] = (share, a, b)
        for d, i, a, b in self.index.regions(texts) if word_index else ():
            if best.get((d, i), (0,))[0] < 1:
                got = self.index.best(i, lists[d], a, b)
                if got and got[0] > best.get((d, i), (0,))[0]:
                    best[d, i] = got
        for (d, i), found in best.items():
            yield d, self.ids[i], *found
        for n in self.sizes:
            for d, w in enumerate(texts):
                for a in range(w.size - n + 1):
                    for item in self.short.get(w[a : a + n].tobytes(), ()):
                        yield d, item, 1.0, a, a + n


#: The block that a worker holds, by its path.
_held: dict[str, Block] = {}


def _block(path: str) -> Block:
    if path not in _held:
        _held.clear()
        fs, at = file_system(path)
        with fs.open_input_stream(at) as f:
            _held[path] = pickle.loads(f.read())
    return _held[path]


def _blocks(items: DataFrame, folder: str, latent: Latent, **how) -> list[str]:
    """The items in blocks of at most BLOCK_PASSAGES passages, written one after the other."""
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)
    paths, ids, words, passages = [], [], [], 0

    def write():
        name = f"block-{len(paths):06d}"
        with fs.open_output_stream(f"{at}/{name}") as f:
            f.write(pickle.dumps(Block(ids, words, latent, **how)))
        paths.append(f"{folder}/{name}")

    for r in items.orderBy("item_id", "words").toLocalIterator():
        w = np.frombuffer(r["words"], "<u4")
        n = len(_passages(w))
        if ids and passages + n > BLOCK_PASSAGES:
            write()
            ids, words, passages = [], [], 0
        ids.append(r["item_id"])
        words.append(w)
        passages += n
    if ids:
        write()
    return paths


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    cosine: float = 0.45,
    cover: float = 0.7,
    least: float = 0.5,
    answer_cover: float = 0.8,
    word_index: bool = True,
) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, last_word): items found in documents.

    One row per document and item, with the largest share of the item's words that a place
    of the document (words first_word to last_word - 1) holds in order.  Places are those
    around latent neighbours and, by the word index, all others of ``span`` words; items of
    SHORT to BRIEF words need the share ``cover`` away from latent neighbours.  Items without
    a word find nothing; items of fewer than SHORT words are found where all their words
    follow each other.  Without ``word_index`` latent neighbours alone are verified, which
    shows what they find by themselves.  Null texts hold nothing, rows of a null item_id are not searched for,
    a null doc_id is reported as null.  Rows of the same doc_id report together, of equal
    places the first one.  Texts of any length are searched whole, their windows some
    thousands at a time.  Empty tables give an empty result; other columns are left out.
    """
    spark = docs.sparkSession

    def hashed(name):
        def run(batches):
            for batch in slices(batches):
                yield pa.RecordBatch.from_arrays([batch.column(name), pa.array([word_hashes(t).astype("<u4").tobytes() for t in texts_of(batch)], pa.binary())], [name, "words"])

        return run

    words = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hashed("doc_id"), "doc_id long, words binary"), "words")
    listed = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    items = stored(listed.mapInArrow(hashed("item_id"), "item_id long, words binary").distinct(), "items")
    latent = fit(words, items)
    paths = _blocks(items, f"{shared_dir(spark)}-blocks", latent, cover=cover, least=least, answer_cover=answer_cover)
    space = spark.sparkContext.broadcast(latent)  # FEATURES x LATENT numbers

    def find(batches):
        latent = space.value
        for batch in slices(batches, "words"):
            ids = batch.column("doc_id").to_pylist()
            texts = [np.frombuffer(raw, "<u4") for raw in batch.column("words").to_pylist()]
            lists = [w.tolist() for w in texts]
            windows = latent.windows(texts)
            rows = [(ids[d], *x) for path in paths for d, *x in _block(path).search(texts, lists, windows, cosine, word_index)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "similarity", "first_word", "last_word"])

    got = words.mapInArrow(find, "doc_id long, item_id long, similarity double, first_word long, last_word long")
    best = F.max_by(F.struct("similarity", "first_word", "last_word"), F.struct("similarity", -F.col("first_word"), -F.col("last_word")))
    return got.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.*")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` in which no item of the benchmark is found, with all their columns.

    Rows without an id stay; if one of the rows of an id holds an item, all rows of it go.
    """
    return without_ids(docs, leaks(docs, benchmark, **how))
