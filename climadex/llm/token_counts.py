"""Token counts from pre-token frequencies; ids are never made for a document.

1. One scan gives the distinct pre-tokens with the number of documents that hold them; each
   task sums its own first.  The pieces of each one that several documents hold are counted,
   once, and a Bloom filter remembers which these are.
2. A second scan gives the pre-token frequencies of each document.  They are joined to the
   table of counts: pre-tokens of many documents, a number of them that is bounded, by a
   broadcast part of it, so their frequencies never leave the task; the others by a shuffle,
   in which no key is hot.  What the filter does not hold has this one document, and is
   counted where it stands; what it holds by mistake is counted after the join.
3. Frequency times pieces is summed per document.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, slices, stored, texts_of
from .line_dedup import SHARDS, _bits, _block, _positions, _suspected
from .tokens import default_path, piece_counter

#: Pre-tokens that a task sums before it sends them on.
HELD = 500_000
#: Counts that are broadcast: those of the pre-tokens of most documents.
BROADCAST_TOKENS = 1 << 19
#: Bits of the filter of shared pre-tokens; results do not depend on it.
SHARED_BITS = 1 << 27


def _hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in tokens), np.uint64, len(tokens))


def pre_token_pieces(docs: DataFrame, path: str) -> DataFrame:
    """(token, n_docs, pieces) of each distinct pre-token that several documents hold."""

    def sent(seen: Counter):
        items = list(seen.items())
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["token", "n_docs"])

    def distinct(batches):
        counter, seen = piece_counter(path), Counter()
        for batch in slices(batches):
            for text in texts_of(batch):
                seen.update(set(counter.pre_tokens(text)))
            if len(seen) > HELD:
                yield from sent(seen)
                seen = Counter()
        yield from sent(seen)

    def count(batches):
        counter = piece_counter(path)
        for batch in slices(batches, "token"):
            tokens = batch.column("token").to_pylist()
            counter.learn(set(tokens))
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("n_docs"), pa.array([counter.cache[t] for t in tokens], pa.int64())], ["token", "n_docs", "pieces"])

    found = docs.select("text").mapInArrow(distinct, "token string, n_docs long").groupBy("token").agg(F.sum("n_docs").alias("n_docs"))
    return found.where("n_docs > 1").mapInArrow(count, "token string, n_docs long, pieces long")


def _common(pieces: DataFrame, most: int) -> dict[str, int]:
    """Pieces of the pre-tokens of most documents, at most ``most`` of them, by powers of two."""
    levels = {r["level"]: r["count"] for r in pieces.groupBy(F.floor(F.log2("n_docs")).alias("level")).count().collect()}
    least, number = 64, 0
    for level in sorted(levels, reverse=True):
        number += levels[level]
        if number > most:
            break
        least = level
    return {r["token"]: r["pieces"] for r in pieces.where(F.col("n_docs") >= 1 << least).select("token", "pieces").collect()} if least < 64 else {}


def shared_filter(pieces: DataFrame, filter_bits: int) -> bytes:
    """Bloom filter of the pre-tokens of ``pieces``: SHARDS equal blocks, one after the other."""
    shard_bits = filter_bits.bit_length() - 1 - 8

    def build(batches):
        for batch in slices(batches, "token"):
            hashes = np.sort(_hashes(batch.column("token").to_pylist()))
            shard, a, b = _positions(hashes, shard_bits)
            cuts = np.searchsorted(shard, np.arange(SHARDS + 1))
            rows = [(s, _block(np.r_[a[x:y], b[x:y]], shard_bits)) for s, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary()))], ["shard", "bits"])

    def merge(batches):
        def row():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total).tobytes()], pa.binary())], ["shard", "bits"])

        now, total = None, None
        for batch in batches:
            for s, bits in zip(batch.column("shard").to_pylist(), batch.column("bits").to_pylist()):
                if s != now:
                    if now is not None:
                        yield row()
                    now, total = s, np.zeros(1 << shard_bits, bool)
                total |= _bits(bits, shard_bits)
        if now is not None:
            yield row()

    blocks = pieces.select("token").mapInArrow(build, "shard int, bits binary")
    merged = blocks.repartition(min(SHARDS, partitions(pieces.sparkSession)), "shard").sortWithinPartitions("shard").mapInArrow(merge, "shard int, bits binary")
    size = (1 << shard_bits) // 8
    out = bytearray(SHARDS * size)
    for r in merged.collect():  # at most SHARDS rows of a fixed size
        out[r["shard"] * size : (r["shard"] + 1) * size] = r["bits"]
    return bytes(out)


def count_tokens(docs: DataFrame, *, model_path: str | None = None, limit: int = 4096, broadcast_tokens: int = BROADCAST_TOKENS, filter_bits: int = SHARED_BITS) -> DataFrame:
    """(doc_id, n_bytes, n_pre_tokens, n_tokens, over_limit), a row for each row of ``docs``.

    Null or empty texts have 0 tokens.  Other columns are left out.  Rows with the same
    doc_id, or none, are counted each by itself; whole texts of any length are counted; an
    empty table gives an empty result.  Counts depend on neither ``broadcast_tokens`` nor
    ``filter_bits``.
    """
    path = model_path or default_path("piece_bpe_32k.model")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stored(pre_token_pieces(docs, path), "pieces")
    common = docs.sparkSession.sparkContext.broadcast((_common(pieces, broadcast_tokens), shared_filter(pieces, filter_bits)))
    shard_bits = filter_bits.bit_length() - 1 - 8
    kinds = {"row": pa.int64(), "doc_id": pa.int64(), "n_bytes": pa.int64(), "n_pre_tokens": pa.int64(), "known": pa.int64(), "token": pa.string(), "n": pa.int64()}

    def frequencies(batches):
        counter, (known, bits) = piece_counter(path), common.value
        bits = np.frombuffer(bits, np.uint8)
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            found = [Counter(counter.pre_tokens(t)) for t in texts_of(batch)]
            rest = sorted({t for f in found for t in f if t not in known})
            shared = {t for t, s in zip(rest, _suspected(_hashes(rest), bits, shard_bits)) if s} if rest else set()
            counter.learn(set(rest) - shared)
            own = counter.cache
            of_docs, of_tokens = [], []
            for doc, text, f in zip(batch.column("doc_id").to_pylist(), texts_of(batch), found):
                total = 0
                for t, n in f.items():
                    if (p := known.get(t)) is not None:
                        total += n * p
                    elif t in shared:
                        of_tokens.append((row, None, None, None, None, t, n))
                    else:
                        total += n * own[t]
                of_docs.append((row, doc, len(text.encode("utf-8", "surrogatepass")), f.total(), total, None, None))
                row += 1
            rows = of_docs + of_tokens
            for i in range(0, len(rows), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 100_000]), kinds.values())], list(kinds))

    def counted(batches):
        counter = piece_counter(path)
        for batch in slices(batches, "token"):
            tokens, pieces = batch.column("token").to_pylist(), batch.column("pieces").to_pylist()
            missing = {t for t, p in zip(tokens, pieces) if p is None}
            if missing:  # one document's, which the filter held by mistake
                counter.learn(missing)
                pieces = [counter.cache[t] if p is None else p for t, p in zip(tokens, pieces)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([n * p for n, p in zip(batch.column("n").to_pylist(), pieces)], pa.int64())], ["row", "pieces"])

    # Written once: the numbers of rows stay what they are if a task runs again.
    found = stored(docs.mapInArrow(frequencies, "row long, doc_id long, n_bytes long, n_pre_tokens long, known long, token string, n long"), "frequencies")
    joined = found.where(F.col("n").isNotNull()).select("row", "token", "n").join(pieces.select("token", "pieces"), "token", "left").select("row", "token", "n", "pieces")
    rest = joined.mapInArrow(counted, "row long, pieces long").groupBy("row").agg(F.sum("pieces").alias("rest"))
    out = found.where(F.col("n").isNull()).select("row", "doc_id", "n_bytes", "n_pre_tokens", "known").join(rest, "row", "left")
    n_tokens = F.col("known") + F.coalesce("rest", F.lit(0))
    return out.select("doc_id", "n_bytes", "n_pre_tokens", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
