"""Line deduplication with two Bloom filters.

Three scans of the text, none of which shuffles a line:

1. Every task hashes the distinct line keys of its documents and sends, per
   filter shard, the positions set by keys seen once and by keys seen twice.
   The shards are merged in whatever order their parts come: a bit is *twice* when either side has it
   so, or when both sides have it *once*.  With the positions of a hash in one
   shard, a key of two documents always has all its bits in the twice filter:
   there are false positives, never false negatives.
2. Only keys that the twice filter holds (suspected repeats) are shuffled, as
   128-bit digests with counts that each task has summed before.  The exact sum
   decides, and the smallest doc_id is the first occurrence.
3. The repeated keys are removed from the texts: by a broadcast set up to
   ``broadcast_keys`` of them (they are counted first), by a join on the
   document beyond that.

The filter's size (``filter_bits``) follows the input's, from 16 MB to 128 MB at
most, which is what the driver and each worker hold of it.  On inputs too large
for it the filter fills up, more keys become suspects, and the exact step still
decides: results do not depend on its size.  A task sends its suspects on in
parts of ``HELD`` keys, so it never holds all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, free_name, lean, partitions, plain_names, planned_bytes, slices, stored, texts_of, with_column

SHARDS = 256
#: Suspected keys that a task sums before it sends them on.
HELD = 500_000


def line_key(line: bytes) -> bytes:
    """Strip ``[\\x20\\x09-\\x0D]`` at both ends, lower-case A-Z (bytes methods do just that)."""
    return line.strip().lower()


def _doc_keys(text: str, min_chars: int) -> set[bytes]:
    keys = {line_key(x) for x in text.encode("utf-8", "surrogatepass").split(b"\n")}
    if min_chars > 1:
        return {k for k in keys if len(k.decode("utf-8", "surrogatepass")) >= min_chars}
    if min_chars == 1:
        keys.discard(b"")
    return keys


def _positions(hashes: np.ndarray, shard_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard and the two positions in it, from disjoint bits of the hash."""
    mask = np.uint64((1 << shard_bits) - 1)
    return (
        (hashes >> np.uint64(56)).astype(np.uint16),
        (hashes & mask).astype(np.uint32),
        ((hashes >> np.uint64(28)) & mask).astype(np.uint32),
    )


def _block(positions: np.ndarray, shard_bits: int) -> bytes:
    """Sparse blocks are lists of positions, full ones are bits; the first byte tells."""
    positions = np.unique(positions)
    if positions.size * 32 < 1 << shard_bits:
        return b"p" + positions.astype("<u4").tobytes()
    bits = np.zeros(1 << shard_bits, np.uint8)
    bits[positions] = 1
    return b"b" + np.packbits(bits).tobytes()


def _bits(block: bytes, shard_bits: int) -> np.ndarray:
    if block[:1] == b"b":
        return np.unpackbits(np.frombuffer(block, np.uint8, offset=1)).astype(bool)
    out = np.zeros(1 << shard_bits, bool)
    out[np.frombuffer(block, "<u4", offset=1)] = True
    return out


def _add(block: bytes, to: np.ndarray, meet: tuple[np.ndarray, np.ndarray] | None = None) -> None:
    """Set the block's bits in the packed bits ``to``; those it has in common with ``meet[0]`` in ``meet[1]``."""
    if block[:1] == b"b":
        new = np.frombuffer(block, np.uint8, offset=1)
        if meet:
            np.bitwise_or(meet[1], meet[0] & new, out=meet[1])
        np.bitwise_or(to, new, out=to)
        return
    at = np.frombuffer(block, "<u4", offset=1)
    byte, bit = at >> 3, (128 >> (at & 7)).astype(np.uint8)
    if meet:
        np.bitwise_or.at(meet[1], byte, meet[0][byte] & bit)
    np.bitwise_or.at(to, byte, bit)


#: Bytes of merged shards that a task holds, about.
MERGED_BYTES = 32 << 20


def twice_filter(docs: DataFrame, min_chars: int, filter_bits: int) -> bytes:
    """Bits of the twice-seen filter: SHARDS equal blocks, one after the other."""
    spark = docs.sparkSession
    shard_bits = filter_bits.bit_length() - 1 - 8

    def build(batches):
        found = []
        for batch in slices(batches):
            keys = [k for t in texts_of(batch) for k in _doc_keys(t, min_chars)]
            found.append(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
        if not found:
            return
        hashes, counts = np.unique(np.concatenate(found), return_counts=True)
        shard, a, b = _positions(hashes, shard_bits)
        cuts = np.searchsorted(shard, np.arange(SHARDS + 1))  # sorted hashes: sorted shards
        rows = []
        for s in range(SHARDS):
            x = slice(cuts[s], cuts[s + 1])
            if cuts[s] < cuts[s + 1]:
                two = counts[x] > 1
                rows.append((s, _block(np.concatenate([a[x], b[x]]), shard_bits), _block(np.concatenate([a[x][two], b[x][two]]), shard_bits)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["shard", "once", "twice"])

    size = (1 << shard_bits) // 8

    def merge(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for s, o, t in zip(*(batch.column(i) for i in range(3))):
                if (k := s.as_py()) not in held:
                    held[k] = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
                once, twice = held[k]
                _add(t.as_py(), twice)
                _add(o.as_py(), once, (once, twice))
        for k in sorted(held):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([held.pop(k)[1].tobytes()], pa.binary())], ["shard", "twice"])

    blocks = docs.select("text").mapInArrow(lean(build), "shard int, once binary, twice binary")
    # A task holds its shards, once and twice: unsorted, for a sort takes a page of the heap in each task.
    n = min(SHARDS, max(partitions(spark), -(-SHARDS * 2 * size // MERGED_BYTES)))
    merged = blocks.repartition(n, "shard").mapInArrow(lean(merge), "shard int, twice binary")
    out = bytearray(SHARDS * size)
    for r in merged.collect():  # at most SHARDS rows of a fixed size
        out[r["shard"] * size : (r["shard"] + 1) * size] = r["twice"]
    return bytes(out)


def _suspected(hashes: np.ndarray, bits: np.ndarray, shard_bits: int) -> np.ndarray:
    shard, a, b = _positions(hashes, shard_bits)
    base = shard.astype(np.uint64) << np.uint64(shard_bits)

    def at(p):
        q = base + p
        return (bits[q >> np.uint64(3)] >> (7 - (q & np.uint64(7))).astype(np.uint8)) & 1

    return (at(a) & at(b)).astype(bool)


#: Bits of the filter: at least, and at most as its size follows from the input.
LEAST_BITS, MOST_BITS = 1 << 27, 1 << 30
#: Bytes of input to a bit of the filter, a line having about 60 of them and 8 bits.
BYTES_PER_BIT = 8


def filter_bits_for(docs: DataFrame) -> int:
    """A power of two after the planner's estimate of the input's size, from 16 MB to 128 MB of filter."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (planned_bytes(docs) // BYTES_PER_BIT).bit_length()))


def repeated_keys(docs: DataFrame, *, min_docs: int, min_chars: int = 1, filter_bits: int | None = None) -> DataFrame:
    """(digest, n_docs, first_doc) of the keys that at least ``min_docs`` documents hold."""
    spark = docs.sparkSession
    filter_bits = filter_bits or filter_bits_for(docs)
    shard_bits = filter_bits.bit_length() - 1 - 8
    held = spark.sparkContext.broadcast(twice_filter(docs, min_chars, filter_bits) if min_docs > 1 else b"\xff" * (filter_bits // 8))

    def sent(seen: dict[bytes, list]):
        items = list(seen.items())
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())],
                ["digest", "n_docs", "first_doc"],
            )

    def suspects(batches):
        bits = np.frombuffer(held.value, np.uint8)
        seen: dict[bytes, list] = {}
        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                keys = list(_doc_keys(text, min_chars))
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
                for i in np.flatnonzero(_suspected(hashes, bits, shard_bits)):
                    d = xxhash.xxh3_128_digest(keys[i])
                    if (x := seen.get(d)) is None:
                        seen[d] = [1, doc]
                    else:
                        x[0] += 1
                        if x[1] is None or (doc is not None and doc < x[1]):
                            x[1] = doc
            if len(seen) > HELD:
                yield from sent(seen)
                seen = {}
        yield from sent(seen)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(suspects), "digest binary, n_docs long, first_doc long")
    return (
        found.groupBy("digest")
        .agg(F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc"))
        .where(F.col("n_docs") >= min_docs)
    )


def _kept(text: str, doc, gone: dict, min_chars: int, keep_first: bool) -> tuple[str, int, int]:
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    out, seen = [], set()
    for line in lines:
        key = line_key(line)
        digest = xxhash.xxh3_128_digest(key)
        if digest in gone and len(key.decode("utf-8", "surrogatepass")) >= min_chars:
            if not keep_first or gone[digest] != doc or digest in seen:
                continue
            seen.add(digest)
        out.append(line)
    return b"\n".join(out).decode("utf-8", "surrogatepass"), len(lines), len(lines) - len(out)


def dedup_lines(
    docs: DataFrame,
    *,
    min_docs: int = 10,
    min_chars: int = 1,
    keep: str = "none",
    counts: bool = True,
    filter_bits: int | None = None,
    broadcast_keys: int = 1 << 18,
) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, plus ``n_lines`` and ``n_dropped``.

    A text is split at ``\\n``; a null or empty text is one empty line.  A key (see
    ``line_key``) of at least ``min_chars`` code points that at least ``min_docs`` documents
    (rows) hold loses its lines everywhere (``keep="none"``), or everywhere but at its first
    line in the document of smallest id (``keep="first"``).  Repeats inside one document
    count once.  A row repeated as a whole counts as another document.  Other columns pass
    through, whatever their names; existing ``n_lines`` / ``n_dropped`` columns are replaced,
    unless ``counts`` is off, which leaves just the columns of ``docs``.
    Keys are compared by a 128-bit digest.  Nulls: a null text becomes "", a null doc_id is
    a document of its own.  An empty table gives an empty result.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    if filter_bits is not None and (filter_bits & (filter_bits - 1) or not 1 << 16 <= filter_bits <= 1 << 35):
        raise ValueError("filter_bits is a power of two from 2**16 to 2**35")
    spark = docs.sparkSession
    docs, named = plain_names(docs.drop("n_lines", "n_dropped") if counts else docs)
    keys = stored(repeated_keys(docs, min_docs=min_docs, min_chars=min_chars, filter_bits=filter_bits), "keys")
    first = keep == "first"
    columns = docs.columns
    schema = T.StructType([*(f if f.name != "text" else T.StructField("text", T.StringType()) for f in docs.schema), *[T.StructField(c, T.LongType()) for c in ("n_lines", "n_dropped") if counts]])

    def result(batch, gone_of):
        got = [_kept(t, d, gone_of(i), min_chars, first) for i, (t, d) in enumerate(zip(texts_of(batch), batch.column("doc_id").to_pylist()))]
        batch = with_column(batch.select(columns), "text", pa.array([x[0] for x in got], pa.string()))
        if not counts:
            return batch
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64())], [*columns, "n_lines", "n_dropped"])

    if keys.count() <= broadcast_keys:
        small = spark.sparkContext.broadcast({bytes(r["digest"]): r["first_doc"] for r in keys.select("digest", "first_doc").collect()})

        def apply(batches):
            gone = small.value
            for batch in slices(batches):
                yield result(batch, lambda i: gone)

        return named(docs.mapInArrow(lean(apply), schema))

    # Names of helper columns that no column of ``docs`` has.
    doc_name, gone_name = free_name(columns, "__doc"), free_name(columns, "__gone")

    def digests(batches):
        for batch in slices(batches):
            ids, out = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                for k in _doc_keys(text, min_chars):
                    ids.append(doc)
                    out.append(xxhash.xxh3_128_digest(k))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "digest"])

    def apply_joined(batches):
        for batch in slices(batches):
            lists = batch.column(gone_name).to_pylist()
            yield result(batch, lambda i: {bytes(x["digest"]): x["first_doc"] for x in lists[i] or ()})

    in_doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(digests), "doc_id long, digest binary")
    per_doc = in_doc.join(keys, "digest").groupBy(F.col("doc_id").alias(doc_name)).agg(F.collect_set(F.struct("digest", "first_doc")).alias(gone_name))
    joined = docs.join(per_doc, col("doc_id").eqNullSafe(col(doc_name)), "left").select(*map(col, columns), gone_name)
    return named(joined.mapInArrow(lean(apply_joined), schema))
