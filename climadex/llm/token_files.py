"""Token ids in Arrow files of fixed-size-list batches.

A folder holds, per range of doc_ids, ``part-NNNNN.arrow`` (Arrow's random-access file
format: columns ``ids: fixed_size_list<uint16>[length]`` and ``mask:
fixed_size_list<bool>[length]``; the documents' ids run through the sequences, the last
one is padded and masked) and ``part-NNNNN.index.arrow`` (doc_id, n_tokens).  Buffers are
not compressed, so a memory-mapped file gives any sequence without a copy.  Files are
written under a name of the attempt and then renamed: a task that runs again after a loss
replaces its own file with the same content.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, doc_buckets, ranges, shared_dir, slices, texts_of
from .tokens import default_path, word_bpe

#: Sequences in a record batch: 64 x 2048 ids are 256 kB.
BATCH_SEQUENCES = 64


def file_system(uri: str):
    """pyarrow's file system and the path in it; ``file:`` or no scheme is a shared mount."""
    from pyarrow import fs

    x = urlparse(uri)
    if x.scheme in ("", "file"):
        return fs.LocalFileSystem(), x.path
    return fs.FileSystem.from_uri(uri)


@contextmanager
def renamed(fs, path: str):
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        yield out
    fs.move(own, path)


class _Writer:
    """Cuts a stream of ids into sequences and writes them batch by batch."""

    def __init__(self, out, length: int):
        self.length, self.held, self.size = length, [], 0
        self.schema = pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(out, self.schema)

    def _put(self, ids: np.ndarray, n: int) -> None:
        mask = np.arange(ids.size) < n
        self.file.write_batch(
            pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)],
                schema=self.schema,
            )
        )

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += ids.size
        step = self.length * BATCH_SEQUENCES
        if self.size >= step:
            whole = np.concatenate(self.held)
            full = whole.size // step * step
            for i in range(0, full, step):
                self._put(whole[i : i + step], step)
            self.held, self.size = [whole[full:]], whole.size - full

    def close(self) -> None:
        if self.size:
            whole = np.concatenate(self.held)
            padded = np.zeros(-(-whole.size // self.length) * self.length, np.uint16)
            padded[: whole.size] = whole
            self._put(padded, whole.size)
        self.file.close()


def write_token_files(docs: DataFrame, folder: str, *, length: int = 2048, end_id: int = 1, tokenizer_path: str | None = None) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; one row per file.

    Returns (bucket, path, n_docs, n_tokens, start), small enough to be held by the driver:
    a row per range of documents.  Null or empty texts give the end id alone; rows of the
    same doc_id follow each other in the order of their ids' bytes, null doc_ids come first.
    Other columns are left out.
    """
    spark = docs.sparkSession
    path = tokenizer_path or default_path("word_bpe_49k.json")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = doc_buckets(docs, ranges(docs))

    def encode(batches):
        bpe, end = word_bpe(path), np.array([end_id], "<u2").tobytes()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([b + end for b in bpe.encode(texts_of(batch))], pa.binary())], ["doc_id", "ids"])

    def write(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name, index, tokens, writer = None, [], 0, None
        for batch in batches:
            for b, doc, ids in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "ids"))):
                if writer is None:
                    name = f"{base}/part-{b:05d}"
                    bucket, stack = b, renamed(fs, f"{name}.arrow")
                    writer = _Writer(stack.__enter__(), length)
                ids = np.frombuffer(ids, "<u2")
                writer.add(ids)
                index.append((doc, ids.size))
                tokens += ids.size
        if writer is None:
            return
        writer.close()
        stack.__exit__(None, None, None)
        with renamed(fs, f"{name}.index.arrow") as out:
            t = pa.table({"doc_id": pa.array([x[0] for x in index], pa.int64()), "n_tokens": pa.array([x[1] for x in index], pa.int64())})
            with pa.ipc.new_file(out, t.schema) as f:
                f.write_table(t)
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([f"part-{bucket:05d}"]), pa.array([len(index)], pa.int64()), pa.array([tokens], pa.int64())], ["bucket", "path", "n_docs", "n_tokens"])

    ids = docs.mapInArrow(encode, "doc_id long, ids binary").withColumn("bucket", bucket_of(F.col("doc_id"), bounds).cast("int"))
    files = ids.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "ids").mapInArrow(write, "bucket int, path string, n_docs long, n_tokens long")
    rows, start = [], 0
    for r in sorted(files.collect()):  # a row per file
        rows.append((*r, start))
        start += r["n_tokens"]
    return spark.createDataFrame(rows, "bucket int, path string, n_docs long, n_tokens long, start long")


def read_sequence(folder: str, name: str, i: int) -> tuple[np.ndarray, pa.Array]:
    """Ids (a view of the file's buffer where it is memory-mapped) and mask of sequence ``i`` of a file."""
    fs, base = file_system(folder)
    local = type(fs).__name__ == "LocalFileSystem"
    source = pa.memory_map(f"{base}/{name}.arrow") if local else fs.open_input_file(f"{base}/{name}.arrow")
    batch = pa.ipc.open_file(source).get_batch(i // BATCH_SEQUENCES)
    ids, mask = batch.column("ids"), batch.column("mask")
    n, j = ids.type.list_size, i % BATCH_SEQUENCES
    return ids.values.slice(j * n, n).to_numpy(zero_copy_only=True), mask.values.slice(j * n, n)


def _documents(folder: str, name: str) -> Iterator[tuple[int, np.ndarray]]:
    """The documents of a file with their ids, a few record batches in memory at a time."""
    fs, base = file_system(folder)
    with fs.open_input_file(f"{base}/{name}.index.arrow") as f:
        index = pa.ipc.open_file(f).read_all()
    with fs.open_input_file(f"{base}/{name}.arrow") as f:
        file, k, held = pa.ipc.open_file(f), 0, np.empty(0, np.uint16)
        for doc, n in zip(index["doc_id"].to_pylist(), index["n_tokens"].to_pylist()):
            parts, have = [held], held.size
            while have < n:
                batch = file.get_batch(k)
                k += 1
                ids = batch.column("ids").flatten().to_numpy()
                ids = ids[batch.column("mask").flatten().to_numpy(zero_copy_only=False)]
                parts.append(ids)
                have += ids.size
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc, held[:n]
            held = held[n:]


def read_token_files(spark: SparkSession, folder: str, files: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, read back from the files.

    ``ids_crc32`` covers the ids as little-endian unsigned 32-bit integers.
    """

    def read(batches):
        for batch in batches:
            for name, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                rows = []

                def flush(rows):
                    arrays = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))]
                    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

                for doc, ids in _documents(folder, name):
                    rows.append((doc, start, ids.size, zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int32)] if with_ids else [])))
                    start += ids.size
                    if len(rows) >= 2000:
                        yield flush(rows)
                        rows.clear()
                if rows:
                    yield flush(rows)

    n = max(1, files.count())
    names = files.select("bucket", "path", "start").repartitionById(n, F.col("bucket"))
    return names.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_files(docs: DataFrame, **how) -> tuple[str, DataFrame]:
    """Write ``docs`` to a new folder in the shared place; the folder and its files."""
    folder = shared_dir(docs.sparkSession) + "-tokens"
    return folder, write_token_files(docs, folder, **how)
