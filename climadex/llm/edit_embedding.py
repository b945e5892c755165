"""Document fingerprints by a randomised edit embedding.

All documents share one table of random bits r(step, character).  A walk over a text emits
the character it stands on and moves on if r is 1, so after an edit two walks soon fall
into step again: edit distance becomes Hamming distance of the emitted strings (about two
characters emitted per character of the text, the whole text is walked).  The fingerprint
samples the emitted string at positions shared by all texts of the same scale (a power of
two of the walk's length), at the text's own scale and the next one, so texts of slightly
different length have a scale in common.  The walks of many documents run side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, bucket_of, doc_buckets, hash_below, lean, partitions, ranges, scratch, slices, stored, texts_of, with_column
from .components import connected_components

SAMPLES = 256
PERIOD = 4096
END = 255  # class of the position after a text
SEED = 7
#: Text walked at a time; the number of steps is that of its longest document.
WALK_BYTES = 8 << 20
#: Classes of a band bucket that one task compares; larger buckets are dealt over many tasks.
LARGE = 8192
#: Bands of a fingerprint, samples that make a band's key, further ones beside it (4 bits each,
#: 64 in all), and how many of these agree in suspected pairs.
BANDS, WIDTH, SKETCH, SKETCH_LEAST = 16, 8, 16, 9

_rng = np.random.default_rng(SEED)
_MOVES = _rng.integers(0, 2, (PERIOD, 256)).astype(np.int64)
_MOVES[:, END] = 0
_SYMBOL = _rng.integers(1, 16, 256).astype(np.uint8)
_SYMBOL[END] = 0


def _sampled(scale: int) -> np.ndarray:
    """Ascending sample positions below 2**scale."""
    if 1 << scale <= SAMPLES:
        return np.arange(1 << scale)
    picks = np.random.default_rng((SEED, scale)).integers(0, 1 << scale, 4 * SAMPLES)
    picks = np.unique(picks)
    return np.sort(np.random.default_rng((SEED, scale, 1)).permutation(picks)[:SAMPLES])


#: By scale: the first sample of the next scale beyond 2**scale, and what such a sample counts
#: beside those of the scale itself.
_REST = np.array([(np.searchsorted(_sampled(k + 1), 1 << k), 1 if 2 << k <= SAMPLES else 2) for k in range(48)])


def _classes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    high = 128 + ((c * np.uint32(2654435761)) >> np.uint32(20)) % 127
    return np.where(c < 128, c, high).astype(np.uint8)


def embed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scale of each text, and its samples: (texts, 2, SAMPLES) of 1 to 15, 0 past the end."""
    n = np.array([len(t) for t in texts], np.int64)
    scales = np.array([max(1, 2 * int(x)).bit_length() - 1 for x in n], np.int64)
    out = np.zeros((len(texts), 2, SAMPLES), np.uint8)
    order = np.argsort(-n, kind="stable")
    starts = np.r_[0, np.cumsum(n + 1)[:-1]] if len(texts) else n
    buffer = np.full(int((n + 1).sum()), END, np.uint8)
    for t, s, k in zip(texts, starts, n):
        buffer[s : s + k] = _classes(t)
    events: dict[int, list[tuple[int, int]]] = {}
    for scale in range(int(scales.min(initial=64)), int(scales.max(initial=0)) + 2):
        for i, p in enumerate(_sampled(scale)):
            events.setdefault(int(p), []).append((scale, i))
    who, at = order, starts[order]
    step = 0
    while True:
        live = buffer[at] != END
        who, at = who[live], at[live]
        if not who.size:
            return scales, out
        # Longest first, so texts of a scale stand together.
        own = -scales[who]
        now, move = np.empty(who.size, np.uint8), np.empty(who.size, np.int64)
        for step in range(step, step + 256):
            np.take(buffer, at, out=now, mode="clip")
            for scale, i in events.get(step, ()):
                for slot in (0, 1):
                    a, b = np.searchsorted(own, (slot - scale, slot - scale + 1))
                    if a < b:
                        out[who[a:b], slot, i] = _SYMBOL[now[a:b]]
            np.take(_MOVES[step % PERIOD], now, out=move, mode="clip")
            at += move
        step += 1


def to_text(scale: int, samples: np.ndarray) -> str:
    flat = samples.reshape(-1)
    return f"{scale:02x}" + (flat[0::2] << 4 | flat[1::2]).astype(np.uint8).tobytes().hex()


def from_text(fingerprint: str) -> tuple[int, np.ndarray]:
    b = np.frombuffer(bytes.fromhex(fingerprint[2:]), np.uint8)
    return int(fingerprint[:2], 16), np.stack([b >> 4, b & 15], axis=1).reshape(2, SAMPLES)


def _alike(s: np.ndarray, x: np.ndarray, t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Likeness, row by row, of fingerprints (s, x) and (t, y)."""
    d = t - s
    rows = np.arange(len(s))
    a = x[rows, np.where(d >= 0, 1, 0)]
    b = y[rows, np.where(d <= 0, 1, 0)]
    used = (a != 0) | (b != 0)
    # Of neighbouring scales, the longer text goes on where the scale in common ends and the
    # shorter one has ended: that rest, seen at the longer text's next scale, is unequal.
    longer = np.where(d[:, None] >= 0, y[:, 1], x[:, 1])
    cut, weight = _REST[np.maximum(s, t)].T
    rest = np.where(d == 0, 0, ((longer != 0) & (np.arange(SAMPLES) >= cut[:, None])).sum(axis=1) * weight)
    share = ((a == b) & used).sum(axis=1) / np.maximum(used.sum(axis=1) + rest, 1)
    same = (d == 0) & (x == y).all(axis=(1, 2))
    return np.where(same, 1.0, np.where(np.abs(d) <= 1, share, 0.0))


def likeness(a: str, b: str) -> float:
    """Share of equal samples at the largest scale in common, 0 if there is none.

    What the longer text has beyond that scale counts as unequal.
    """
    (s, x), (t, y) = from_text(a), from_text(b)
    return float(_alike(np.array([s]), x[None], np.array([t]), y[None])[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for each row; a null text is empty."""

    def run(batches):
        for batch in slices(batches, most=WALK_BYTES):
            scales, samples = embed(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([to_text(int(s), x) for s, x in zip(scales, samples)])], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by as much of the start of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _packed(rows: DataFrame) -> DataFrame:
    """``rows`` with texts compressed, for the shuffle."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            texts = [None if t is None else pack(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield with_column(batch, "text", pa.array(texts, pa.binary()))

    return rows.select(*[c for c in rows.columns if c != "text"], "text").mapInArrow(lean(run), f"{fields}, text binary")


def _unpacked(rows: DataFrame) -> DataFrame:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            start, texts, size = 0, [], 0
            for i, packed in enumerate(batch.column("text").to_pylist()):
                texts.append(None if packed is None else unpack(packed))
                size += len(texts[-1] or b"")
                if size >= SLICE_BYTES or i == batch.num_rows - 1:
                    yield with_column(batch.slice(start, len(texts)), "text", pa.array(texts, pa.binary()).cast(pa.string()))
                    start, texts, size = i + 1, [], 0

    return rows.select(*[c for c in rows.columns if c != "text"], "text").mapInArrow(lean(run), f"{fields}, text string")


def edited_fingerprints(docs: DataFrame, *, least: float | None = None) -> DataFrame:
    """Each document with its edited text and their fingerprints, and those of the next document.

    Columns: doc_id, n_chars, edited (the text), fingerprint, edited_fingerprint, near_edited,
    near_next, component_id.  The next document is the one of the next doc_id (rows of the same
    doc_id in the order of their texts, null doc_ids first); after the last comes the first.
    component_id is that of ``edit_duplicates`` with the given ``least``, and the doc_id itself
    without one.  One shuffle deals the documents, compressed, into ranges of doc_ids; the first
    document of each range goes to the range before it as well, and so do the components that
    are not the document itself.  A null text is empty; an empty table gives an empty result;
    other columns are left out.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("ord", F.coalesce("doc_id", F.lit(low)))
    bounds = doc_buckets(rows, ranges(docs), "ord")
    rows = rows.withColumn("bucket", bucket_of(F.col("ord"), bounds).cast("int"))
    firsts = sorted((r["bucket"], r["ord"]) for r in rows.groupBy("bucket").agg(F.min("ord").alias("ord")).collect())  # a row per range
    guards = [(ord_, firsts[i - 1][0]) for i, (_, ord_) in enumerate(firsts)]
    guard = spark.createDataFrame(guards or [(low, 0)], "ord long, before int")
    dealt = rows.join(F.broadcast(guard), "ord", "left").select(
        "doc_id", "text", "ord", F.explode(F.when(F.col("before").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guard")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guard")), F.struct(F.col("before").alias("b"), F.lit(1).alias("guard"))))).alias("at")
    )
    dealt = _packed(dealt.select("doc_id", "ord", "at.b", "at.guard", F.lit(None).cast("long").alias("component"), "text"))
    if least is not None:
        # Rows without a text tell the component of the documents after them.
        told = _elsewhere(docs, least).withColumn("ord", F.col("doc_id"))
        told = told.select("doc_id", "ord", bucket_of(F.col("ord"), bounds).cast("int").alias("b"), F.lit(0).alias("guard"), "component", F.lit(None).cast("binary").alias("text"))
        dealt = dealt.unionByName(told)

    def run(batches):
        def done(ids, parts, texts, following):
            edited = [edited_text(t, n) for t, n in zip(texts, following)]
            # The next documents are the texts shifted by one.
            scales, samples = embed([*texts, following[-1], *edited])
            k = len(texts)
            own, then, new = slice(0, k), slice(1, k + 1), slice(k + 1, None)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(edited, pa.string()),
                    pa.array([to_text(int(s), x) for s, x in zip(scales[own], samples[own])]),
                    pa.array([to_text(int(s), x) for s, x in zip(scales[new], samples[new])]),
                    pa.array(_alike(scales[own], samples[own], scales[new], samples[new])),
                    pa.array(_alike(scales[own], samples[own], scales[then], samples[then])),
                    pa.array(parts, pa.int64()),
                ],
                ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id"],
            )

        ids, parts, texts, size = [], [], [], 0
        closed, told = False, (None, None)
        for batch in slices(batches):
            for doc, text, guard, component in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guard", "component"))):
                if closed:
                    continue  # further rows of the guard's doc_id
                if text is None:
                    told = (doc, component)
                    continue
                if guard:
                    closed = True
                    if texts:
                        yield done(ids, parts, texts, [*texts[1:], text])
                    ids, parts, texts = [], [], []
                    continue
                if size >= WALK_BYTES:
                    yield done(ids, parts, texts, [*texts[1:], text])
                    ids, parts, texts, size = [], [], [], 0
                ids.append(doc)
                parts.append(told[1] if doc is not None and doc == told[0] else doc)
                texts.append(text)
                size += len(text)

    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long"
    there = _unpacked(dealt.repartitionById(len(bounds) + 1, F.col("b")))
    return there.sortWithinPartitions("guard", "ord", F.col("text").asc_nulls_first()).select("doc_id", "text", "guard", "component").mapInArrow(lean(run), schema)


def _from_raw(raw: bytes) -> tuple[int, np.ndarray]:
    b = np.frombuffer(raw, np.uint8, offset=1)
    return raw[0], np.stack([b >> 4, b & 15], axis=1).reshape(2, SAMPLES)


def _unpack_raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Scales and samples of a column of binary fingerprints."""
    b = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 1 + SAMPLES)
    return b[:, 0].astype(np.int64), np.stack([b[:, 1:] >> 4, b[:, 1:] & 15], axis=2).reshape(-1, 2, SAMPLES)


def _picks(bands: int, width: int) -> np.ndarray:
    """Sample numbers of each band: those of the key, then those of the sketch."""
    rng = np.random.default_rng((SEED, 99))
    return np.stack([rng.choice(SAMPLES, width + SKETCH, replace=False) for _ in range(bands)])


def _keys(classes: DataFrame, least: float, bands: int, width: int) -> DataFrame:
    """(key, cid, sketch): where each class is looked up, 64-bit hash of scale, band and samples.

    A text meets longer ones at its next scale.  Their likeness is at most the share of their
    numbers of samples there, so texts that are too short for all of that scale are left out.
    """
    picks = _picks(bands, width)

    def fullness(batches):
        for batch in batches:
            if batch.num_rows:
                s, x = _unpack_raw(batch.column("raw"))
                n = (x[:, 0] != 0).sum(axis=1)
                at = np.unique(s)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([int(n[s == k].min()) for k in at])], ["scale", "n"])

    full = {r["scale"]: r["n"] for r in classes.select("raw").mapInArrow(lean(fullness), "scale long, n long").groupBy("scale").agg(F.min("n").alias("n")).collect()}  # a row per scale

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                s, x = _unpack_raw(batch.column("raw"))
                cid = batch.column("cid").to_numpy()
                for slot in (0, 1):
                    some = np.array([slot == 0 or k + 1 in full for k in s], bool)
                    if slot:
                        some &= (x[:, 1] != 0).sum(axis=1) >= least * np.array([full.get(k + 1, 0) for k in s])
                    rows = np.flatnonzero(some)
                    if not rows.size:
                        continue
                    at = s[rows] + slot
                    size = np.minimum(np.int64(1) << at, SAMPLES)  # short texts: all their samples stand first
                    got = x[rows[:, None, None], slot, picks[None] % size[:, None, None]].astype(np.uint64)
                    key = (at.astype(np.uint64) * np.uint64(1 << 20))[:, None] + np.arange(bands, dtype=np.uint64)
                    for w in range(width):
                        key = (key ^ got[:, :, w]) * np.uint64(0x9E3779B97F4A7C15)
                        key ^= key >> np.uint64(29)
                    sketch = np.zeros_like(key)
                    for w in range(SKETCH):
                        sketch = sketch << np.uint64(4) | got[:, :, width + w]
                    yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(cid[rows], bands)), pa.array(sketch.reshape(-1).view(np.int64))], ["key", "cid", "sketch"])

    return classes.select("raw", "cid").mapInArrow(lean(run), "key long, cid long, sketch long")


def _dealt(rows: DataFrame, large: int) -> DataFrame:
    """``rows`` with columns i, j: a group (key, i, j) has about ``large`` rows at most.

    A larger bucket is cut into parts by hash, and each pair of parts is a group.  Sizes are
    taken from a fixed share of the rows: they decide where rows are compared, not which.
    """
    share = min(1.0, 128 / large)
    sizes = rows.where(hash_below(share, "cid")).groupBy("key").agg((F.count(F.lit(1)) / F.lit(share)).alias("n")).where(F.col("n") > large)
    sizes = stored(sizes, "large-buckets")
    if sizes.isEmpty():
        return rows.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"))
    parts = F.coalesce(F.ceil(F.col("n") / F.lit(max(1, large // 2))), F.lit(1)).cast("int")
    cut = rows.join(sizes, "key", "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("parts")).cast("int"))
    cut = cut.select("key", "cid", "sketch", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return cut.select("key", "cid", "sketch", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _suspects(batches):
    """Rows of sorted groups (key, i, j) whose sketch is near another one's of the group."""

    def near(sketch):
        keep, left = np.zeros(sketch.size, bool), np.arange(sketch.size)
        while left.size:
            at = left[0]
            d = sketch ^ sketch[at]
            d |= d >> np.uint64(1)
            d |= d >> np.uint64(2)
            d &= np.uint64(0x1111111111111111)
            alike = np.bitwise_count(d) <= SKETCH - SKETCH_LEAST
            alike[at] = False
            if alike.any():
                keep |= alike
                keep[at] = True
            left = left[1:][~keep[left[1:]]]
        return keep

    def judged(columns):
        key, i, j, cid, sketch = columns
        n = key.size
        new = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])] if n else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], n]
        keep = np.zeros(n, bool)
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            keep[a:b] = near(sketch[a:b])
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (key, i, j, cid)], ["key", "i", "j", "cid"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in ("key", "i", "j", "cid", "sketch")]
        columns[4] = columns[4].view(np.uint64)
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held, columns)]
        # The last group may go on in the next batch.
        last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1]) & (columns[2] == columns[2][-1])
        cut = int(np.argmax(last))
        held = [c[cut:] for c in columns]
        if cut:
            yield judged([c[:cut] for c in columns])
    if held is not None:
        yield judged(held)


def _components(docs: DataFrame, least: float, bands: int, width: int, large: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, raw, cid, c2) of each row, stored, and (cid, c2, component_id) of each class of equal fingerprints."""
    known = fingerprints(docs).select("doc_id", F.unhex("fingerprint").alias("raw"))
    known = stored(known.withColumn("cid", F.xxhash64("raw")).withColumn("c2", F.xxhash64(F.lit(1), "raw")), "edit-fingerprints")
    classes = known.where(F.col("doc_id").isNotNull()).groupBy("raw").agg(F.min("doc_id").alias("rep"))
    classes = stored(classes.withColumn("cid", F.xxhash64("raw")).withColumn("c2", F.xxhash64(F.lit(1), "raw")), "edit-classes")

    def links(batches):
        def bucket(raws, reps):
            got = [_from_raw(f) for f in raws]
            s, x = np.array([g[0] for g in got]), np.stack([g[1] for g in got])
            reps, labels = np.array(reps), np.arange(len(raws))
            for i in range(len(raws) - 1):
                far = np.flatnonzero(labels[i + 1 :] != labels[i]) + i + 1
                alike = far[_alike(np.full(len(far), s[i]), np.broadcast_to(x[i], (len(far), *x.shape[1:])), s[far], x[far]) >= least]
                roots = np.unique(np.r_[labels[i], labels[alike]])
                if roots.size > 1:
                    labels[np.isin(labels, roots)] = roots[0]
            root = np.full(len(raws), np.iinfo(np.int64).max)
            np.minimum.at(root, labels, reps)
            root = root[labels]
            return pa.RecordBatch.from_arrays([pa.array(reps[reps != root], pa.int64()), pa.array(root[reps != root], pa.int64())], ["a", "b"])

        now, raws, reps = None, [], []
        for batch in batches:
            for raw, rep, *key in zip(*(batch.column(c).to_pylist() for c in ("raw", "rep", "key", "i", "j"))):
                if key != now:
                    if len(raws) > 1:
                        yield bucket(raws, reps)
                    now, raws, reps = key, [], []
                raws.append(raw)
                reps.append(rep)
        if len(raws) > 1:
            yield bucket(raws, reps)

    n, group = partitions(docs.sparkSession), ["key", "i", "j"]
    rows = _dealt(_keys(classes, least, bands, width), large).repartition(n, *group).sortWithinPartitions(*group)
    suspects = rows.mapInArrow(lean(_suspects), "key long, i int, j int, cid long")
    whole = suspects.join(classes.select("cid", "rep", "raw"), "cid")
    found = whole.repartition(n, *group).sortWithinPartitions(*group).mapInArrow(lean(links), "a long, b long").distinct()
    # A doc_id on rows of different texts links their classes.
    own = known.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    twice = known.join(own, "doc_id").join(classes, ["cid", "c2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    parts = connected_components(found.unionByName(twice))
    named = classes.join(parts, classes["rep"] == parts["node"], "left").select("cid", "c2", F.coalesce("component", "rep").alias("component_id"))
    return known, named


def _elsewhere(docs: DataFrame, least: float) -> DataFrame:
    """(doc_id, component), stored: documents whose component has a smaller doc_id than their own."""
    with scratch(docs.sparkSession) as tables:
        known, named = _components(docs, least, BANDS, WIDTH, LARGE)
        out = known.join(named, ["cid", "c2"]).where(F.col("component_id") != F.col("doc_id"))
        out = stored(out.select("doc_id", F.col("component_id").alias("component")).distinct(), "edit-components")
        tables.clear(keep=tables.folders[-1:])
    return out


def edit_duplicates(docs: DataFrame, *, least: float = 0.8, bands: int = BANDS, width: int = WIDTH, large: int = LARGE) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents linked by fingerprints at least ``least`` alike.

    Equal fingerprints are one class.  Each band samples ``width`` positions of a scale;
    classes that agree there meet in a bucket.  SKETCH further samples, SKETCH_LEAST of which
    agree, make two of them suspects; the whole fingerprints of suspects are compared
    (verification) and each member is linked to the root of its component; pairs that are in
    one component already are not compared again.  A link is found unless all bands miss it:
    were samples independent, 1 in 19, 1 in 110 and 1 in 8 000 at likeness 0.8, 0.85 and 0.9;
    the README has measured figures.  Buckets of more
    than ``large`` classes are dealt over many tasks, part by part; results do not depend on
    it.  Null doc_ids link nothing and have a null component; rows that repeat a doc_id are
    one document in the links.  An empty table gives an empty result.
    """
    known, named = _components(docs, least, bands, width, large)
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return known.join(named, ["cid", "c2"], "left").select("doc_id", F.lower(F.hex("raw")).alias("fingerprint"), component.alias("component_id"))
