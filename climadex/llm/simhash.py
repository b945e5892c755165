"""SimHash near-duplicates, compared bit-sliced.

Equal fingerprints are one class with its smallest doc_id.  Two fingerprints that differ in
at most ``radius`` bits agree on at least ``blocks - radius`` of ``blocks`` blocks of bits,
so every link meets in a bucket of one of the choose(blocks, radius) tables: no link is
lost and no bucket has a cap.  The number of blocks follows the number of classes, so buckets
stay small; one that does not is set aside by its task and compared by many tasks, each
taking two of its parts.  In a bucket the bit planes are stored vertically, so one
word operation updates the distances of 64 lanes; carry-save adders count the differing
bits and a comparison stops as soon as all lanes exceed the radius.  What a bucket sends on
is one link per member to the root of its component there, not pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, partitions, slices, stored, texts_of, without_ids
from .components import connected_components

#: Buckets up to this size are compared lane against shifted lane, larger ones row by block.
SMALL = 48
#: A task compares buckets up to this size; parts of larger ones have half of it.
LARGE = 1 << 16


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    words = words_of(text)
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, seed) for p in parts), "<u8", len(parts))
    counts = np.zeros(64, np.int64)
    for i in range(0, hashes.size, 1 << 14):
        some = hashes[i : i + (1 << 14)]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > hashes.size, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp), fp as a signed 64-bit integer."""

    def run(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle, seed) for t in texts_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def lanes_within(diff, radius: int, bits: int = 64):
    """Lanes (bits of words) in which at most ``radius`` (up to 7) of the planes ``diff(p)`` are set.

    None as soon as no lane can be: the block is abandoned.
    """
    c0 = c1 = c2 = over = None

    def exceeded():
        out = over.copy()
        for v in range(radius + 1, 8):
            out |= (c0 if v & 1 else ~c0) & (c1 if v & 2 else ~c1) & (c2 if v & 4 else ~c2)
        return out

    def add(s, x, y):  # a carry-save adder: sum and carry
        t = s ^ x
        return t ^ y, (s & x) | (t & y)

    for p in range(0, bits, 4):
        w, x, y, z = diff(p), diff(p + 1), diff(p + 2), diff(p + 3)
        if c0 is None:
            c0, c1, c2, over = (np.zeros_like(w) for _ in range(4))
        c0, twos = add(c0, w, x)
        c0, more = add(c0, y, z)
        c1, fours = add(c1, twos, more)
        over |= c2 & fours
        c2 ^= fours
        if p % 8 == 4 and p >= 12 and (~exceeded() == 0).all():
            return None
    return ~exceeded()


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes, one row each, a byte per lane."""
    return np.ascontiguousarray(np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T)


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    while True:
        low = np.minimum(labels[i], labels[j])
        new = labels.copy()
        np.minimum.at(new, labels[i], low)
        np.minimum.at(new, labels[j], low)
        new = np.minimum(new, new[new])
        if (new == labels).all():
            return labels
        labels = new


def _small_buckets(fps: np.ndarray, bucket: np.ndarray, radius: int) -> np.ndarray:
    """Labels of the lanes, all small buckets compared at once: lane i with lane i + d."""
    planes, n = _planes(fps), len(fps)
    ends, others = [], []
    for d in range(1, SMALL):
        same = bucket[:-d] == bucket[d:]
        if not same.any():
            break
        packed = np.packbits(planes[:, :-d] ^ planes[:, d:], axis=1)
        got = lanes_within(packed.__getitem__, radius)
        if got is not None:
            hit = np.flatnonzero(np.unpackbits(got)[: n - d].astype(bool) & same)
            ends.append(hit)
            others.append(hit + d)
    labels = np.arange(n)
    return _merge(labels, np.concatenate(ends), np.concatenate(others)) if ends else labels


def _large_bucket(fps: np.ndarray, radius: int) -> np.ndarray:
    """Labels of the lanes of one bucket: blocks of 64 rows against the lanes from there on."""
    n = len(fps)
    width = -(-n // 64)
    bits = np.zeros((64, width * 64), np.uint8)
    bits[:, :n] = _planes(fps)
    planes = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    rows = np.where(bits.astype(bool), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    labels = np.arange(n)
    for k in range(width):
        size = min(64, n - 64 * k)
        ask, lanes = rows[:, 64 * k : 64 * k + size], planes[:, k:]
        got = lanes_within(lambda p: lanes[p][None, :] ^ ask[p][:, None], radius)
        if got is None:
            continue
        for q in np.flatnonzero(got.any(axis=1)):
            hit = np.flatnonzero(np.unpackbits(got[q].view(np.uint8), bitorder="little")[: n - 64 * k]) + 64 * k
            roots = labels[hit]
            if (roots != roots[0]).any():
                roots = np.unique(roots)
                labels[np.isin(labels, roots)] = roots[0]
    return labels


def _bucket_links(fps: np.ndarray, reps: np.ndarray, keys: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets (equal keys stand together): members to their component's smallest id."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    lane_size = np.repeat(sizes, sizes)
    found = []
    few = np.flatnonzero((lane_size > 1) & (lane_size <= SMALL))
    if few.size:
        found.append((few, _small_buckets(fps[few], np.repeat(starts, sizes)[few], radius)))
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        found.append((np.arange(s, s + n), _large_bucket(fps[s : s + n], radius)))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for lanes, labels in found:
        own = reps[lanes]
        root = np.full(len(lanes), np.iinfo(np.int64).max)
        np.minimum.at(root, labels, own)
        root = root[labels]
        a.append(own[own != root])
        b.append(root[own != root])
    return np.concatenate(a), np.concatenate(b)


def blocks_for(n: int, radius: int) -> int:
    """Number of blocks of bits with the least work for ``n`` classes: rows of all tables and comparisons."""

    def work(blocks: int) -> float:
        return comb(blocks, radius) * n * (1 + n / 2 ** (64 * (blocks - radius) / blocks) / 64)

    return min(range(radius + 1, radius + 9), key=lambda b: (work(b), b))


def _grouped(batches, keys: tuple[str, ...], most: int | None = None):
    """Arrays (fp, rep, *keys) of whole buckets of sorted rows, some buckets at a time.

    With ``most``, the rows of a bucket that grows beyond it come as they stand, marked False.
    """
    names = ("fp", "rep", *keys)
    held, aside = [np.empty(0, np.int64)] * len(names), None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = [np.concatenate([x, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for x, c in zip(held, names)]
        if aside is not None:  # the bucket set aside goes on
            same = np.logical_and.reduce([x == v for x, v in zip(held[2:], aside)])
            n = int(same.sum())  # sorted rows: it stands first
            if n:
                yield False, [x[:n] for x in held]
                held = [x[n:] for x in held]
            if len(held[0]):
                aside = None
        if not len(held[0]):
            continue
        other = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in held[2:]]))
        cut = other[-1] + 1 if other.size else 0  # the last bucket may go on
        if cut:
            yield True, [x[:cut] for x in held]
            held = [x[cut:] for x in held]
        if most is not None and len(held[0]) > most:
            aside = [x[-1] for x in held[2:]]
            yield False, held
            held = [x[:0] for x in held]
    if len(held[0]):
        yield True, held


def fingerprint_links(classes: DataFrame, *, radius: int = 4, blocks: int | None = None, large: int = LARGE) -> DataFrame:
    """Spanning links (a, b) of all pairs of ``classes`` (fp, rep) within the radius.

    ``blocks`` follows the number of classes if it is not given; links do not depend on it,
    nor on ``large``, the size beyond which a bucket is dealt over many tasks.
    """
    blocks = blocks or blocks_for(max(1, classes.count()), radius)
    if not 0 <= radius < blocks or radius > 7:
        raise ValueError("0 <= radius < blocks, radius <= 7")
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for held in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in held)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)

    def links(rows):
        turn = np.r_[False, np.logical_or.reduce([x[1:] != x[:-1] for x in rows[2:]])].cumsum()
        return _bucket_links(rows[0].view(np.uint64), rows[1], turn, radius)

    def out(a, b, t=None, key=None):
        nothing = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), nothing if t is None else pa.array(t, pa.int64()), nothing if key is None else pa.array(key, pa.int64())], ["a", "b", "t", "key"])

    def compare(batches):
        for whole, rows in _grouped(batches, ("t", "key"), large):
            if whole:
                yield out(*links(rows))
            else:
                yield out(*rows)  # a row of a large bucket: fingerprint, representative, bucket

    def compare_parts(batches):
        for _, rows in _grouped(batches, ("t", "key", "i", "j")):
            yield out(*links(rows))

    schema = "a long, b long, t long, key long"
    tables = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)]))
    rows = classes.select("fp", "rep", tables.alias("b")).select("fp", "rep", "b.t", "b.key")
    n = partitions(classes.sparkSession)
    found = stored(rows.repartition(n, "t", "key").sortWithinPartitions("t", "key").mapInArrow(compare, schema), "bucket-links")
    done = found.where("t is null").select("a", "b")
    aside = found.where("t is not null").select(F.col("a").alias("fp"), F.col("b").alias("rep"), "t", "key")
    if aside.isEmpty():
        return done.distinct()
    # Each pair of parts of a large bucket meets in one task: rows are repeated once per part.
    parts = aside.groupBy("t", "key").agg(F.ceil(F.count(F.lit(1)) / F.lit(max(1, large // 2))).cast("int").alias("parts"))
    dealt = aside.join(parts, ["t", "key"]).withColumn("own", F.pmod(F.xxhash64("fp", "rep"), F.col("parts")).cast("int"))
    dealt = dealt.select("fp", "rep", "t", "key", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("fp", "rep", "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    more = dealt.repartition(n, "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j").mapInArrow(compare_parts, schema)
    return done.unionByName(more.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 4, seed: int = 42, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``docs``.

    ``fingerprint`` has 16 hexadecimal digits; documents whose fingerprints are linked by
    steps of at most ``radius`` bits share a component, named by its smallest doc_id.  A null
    or empty text, or one of white space only, has fingerprint zero and is linked like any
    other.  A null doc_id links nothing and has a null component.  Rows that repeat a doc_id
    are one document in the links.  Other columns are left out.  Texts of any length are
    hashed whole, some shingles at a time; equal fingerprints are compared once, whatever
    their number; an empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, shingle=shingle, seed=seed), "fingerprints")
    classes = stored(fps.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    # A doc_id on rows of different texts links their classes.
    own = fps.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    twice = fps.join(own, "doc_id").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = fingerprint_links(classes, radius=radius, blocks=blocks).unionByName(twice)
    parts = connected_components(links)
    named = classes.join(parts, classes["rep"] == parts["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = fps.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each component: the document of smallest id.

    Rows without an id stay, all of them.  If rows repeat the id that is kept, one stays, that
    of the least hash of its columns.  All columns pass through, whatever their names.
    """
    found = near_duplicates(docs, **how)
    kept = without_ids(docs, found.where(F.col("doc_id") != F.col("component_id")))
    name = free_name(docs.columns, "__row")
    repeated = stored(found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(name)), "repeated")
    if repeated.isEmpty():
        return kept
    whole = kept.join(repeated, col("doc_id") == col(name), "left_semi")
    mark = F.xxhash64(*[col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])
    one = whole.groupBy(col("doc_id").alias(name)).agg(F.min_by(F.struct(*map(col, docs.columns)), mark).alias("row")).select("row.*")
    return without_ids(kept, repeated.select(col(name).alias("doc_id"))).unionByName(one)
