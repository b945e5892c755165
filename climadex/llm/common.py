"""Helpers shared by the operators: reading, batching, shared tables, id filters."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python sees at most this much text at once, whatever the length of the rows
#: (a single longer document is one slice of its own).
SLICE_BYTES = 4 << 20
#: A list of document ids is broadcast up to this many rows, and joined beyond.
BROADCAST_IDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def col(name: str):
    """The column of just this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(taken: Iterable[str], base: str) -> str:
    """``base``, with underscores added until no column has this name in any case."""
    taken = {x.lower() for x in taken}
    while base.lower() in taken:
        base += "_"
    return base


def plain_names(df: DataFrame):
    """``df`` with plain names for columns that ``mapInArrow`` cannot name, and the way back for a result."""
    taken, old = list(df.columns), {}
    for i, c in enumerate(df.columns):
        if "." in c or "`" in c:
            old[name := free_name(taken, f"column_{i}")] = c
            taken.append(name)
    if not old:
        return df, lambda out: out
    new = {c: n for n, c in old.items()}
    return df.toDF(*[new.get(c, c) for c in df.columns]), lambda out: out.toDF(*[old.get(c, c) for c in out.columns])


def _own_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/climadex-stored"
    return f"{base.rstrip('/')}/climadex-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the checkpoint folder that all executors share; it goes when the application ends."""
    own = _own_folder(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{own}/{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete all that this application has stored; results not yet written elsewhere go with it."""
    _delete(spark, _own_folder(spark))


class Scratch:
    """Folders of tables that a computation has stored and needs no more once it is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def clear(self, keep: Iterable[str] = ()) -> None:
        for folder in [f for f in self.folders if f not in set(keep)]:
            self.folders.remove(folder)
            _delete(self.spark, folder)


_open: list[Scratch] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Collects the folders of ``stored`` inside the block; the caller clears those it no longer needs."""
    own = Scratch(spark)
    _open.append(own)
    try:
        yield own
    finally:
        _open.remove(own)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: losing an executor afterwards costs no recomputation, and
    nondeterministic columns (partition numbers) are fixed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{name}"
    for s in _open:
        s.folders.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_below(share: float, *columns: str):
    """Condition that holds for a fixed share of all values of ``columns``: their hash is below a threshold."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(*columns) < F.lit(-(1 << 63) + int(share * (1 << 64)))


def sampled_rows(rows: DataFrame, n: int, name: str, *, by: str | None = None, most: int = 1000) -> DataFrame:
    """About ``n`` rows of different ids (of each of the ``most`` largest values of ``by``), stored; (doc_id, by, text).

    Ids whose hash is below a threshold are taken; the threshold comes from one count of the
    different ids, so no task sends on more than its share of the sample and no key is sorted
    in one place.  Rows that repeat an id are merged where they stand: the least text stays.
    Rows without an id are left out.
    """
    rows = rows.where(F.col("doc_id").isNotNull())
    number = F.approx_count_distinct("doc_id", 0.02).alias("n")
    if by is None:
        total = rows.agg(number).first()["n"]
        few = rows.where(hash_below(n / max(total, 1), "doc_id"))
        keys = ["doc_id"]
    else:
        counts = rows.groupBy(by).agg(number).orderBy(F.desc("n"), by).limit(most)
        limit = F.when(F.col("n") <= n, F.lit((1 << 63) - 1)).otherwise((F.lit(float(n)) / F.col("n") * F.lit(2.0**64) - F.lit(2.0**63)).cast("long"))
        limits = rows.sparkSession.createDataFrame(counts.select(by, limit.alias("__limit")).collect(), f"{by} string, __limit long")
        few = rows.join(F.broadcast(limits), by).where(F.xxhash64("doc_id") <= F.col("__limit"))
        keys = ["doc_id", by]
    return stored(few.groupBy(*keys).agg(F.min("text").alias("text")), name)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds at most ``most`` bytes in each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def give_back() -> None:
    """Hand memory that this process has freed back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):
        pass


def lean(run):
    """``run`` for ``mapInArrow``, after which a Python worker, which outlives its tasks, keeps no freed memory."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def with_column(batch: pa.RecordBatch, column: str, values: pa.Array) -> pa.RecordBatch:
    i = batch.schema.get_field_index(column)
    return batch.set_column(i, pa.field(column, values.type), values)


def without_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in ``ids`` (null ids stay).

    The list of ids is counted first: it is broadcast when it is provably small
    and is joined by a shuffle otherwise.
    """
    name = free_name(docs.columns, "__id")
    ids = stored(ids.select(col(column).alias(name)).where(col(name).isNotNull()).distinct(), "ids")
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, col(column) == col(name), "left_anti")


def crc32_mod5(column: str = "doc_id"):
    """crc32 of the id written as text, modulo 5; held-out rows have 0."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


#: Text of a range of documents that is sorted and written by one task.
RANGE_BYTES = 256 << 20


def planned_bytes(df: DataFrame) -> int:
    """Size of the tables that ``df`` reads as the planner knows it, without a scan; those of unknown size count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def ranges(docs: DataFrame) -> int:
    """Number of ranges of documents: by size, at least that of shuffle partitions."""
    return max(partitions(docs.sparkSession), -(-planned_bytes(docs) // RANGE_BYTES))


def doc_buckets(docs: DataFrame, n: int, column: str = "doc_id") -> list[int]:
    """At most ``n - 1`` ascending ids which cut the documents into even ranges."""
    if n <= 1:
        return []
    at = [i / n for i in range(1, n)]
    got = docs.agg(F.percentile_approx(column, at, max(10_000, 10 * n)).alias("q")).first()["q"]
    return sorted(set(got or []))


def bucket_of(column, bounds: list[int]):
    """Number of bounds that are <= the id; null ids go to bucket 0.

    Two steps inside the JVM, over every k-th bound and over the k bounds after the last of
    these: 2 sqrt(n) comparisons.
    """
    if not bounds:
        return F.lit(0)
    k = max(1, int(len(bounds) ** 0.5))

    def below(array):
        return F.coalesce(F.size(F.filter(array, lambda b: b <= column)), F.lit(0))

    coarse = below(F.array(*[F.lit(int(b)) for b in bounds[::k]]))
    if k == 1:
        return coarse
    blocks = F.array(*[F.array(*[F.lit(int(b)) for b in bounds[i : i + k]]) for i in range(0, len(bounds), k)])
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * k + below(F.get(blocks, coarse - 1)))


def long_field(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def sum_vectors(parts: DataFrame, length: int, *, kind: str = "<f8"):
    """Sum over tasks of a vector of fixed length, sent in blocks (block int, data binary).

    Blocks are added as a stream, one in memory at a time; the driver gets one row per block,
    ``length`` numbers in all.
    """
    import numpy as np

    def add(batches):
        def row():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "data"])

        now, total = None, None
        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                if b != now:
                    if now is not None:
                        yield row()
                    now, total = b, np.zeros(len(data) // np.dtype(kind).itemsize, kind)
                total += np.frombuffer(data, kind)
        if now is not None:
            yield row()

    n = partitions(parts.sparkSession)
    got = parts.repartition(n, "block").sortWithinPartitions("block").mapInArrow(add, "block int, data binary").collect()
    out = np.zeros(length, kind)
    for r in got:
        data = np.frombuffer(r["data"], kind)
        out[r["block"] * BLOCK : r["block"] * BLOCK + data.size] = data
    return out


#: Numbers in a block of ``sum_vectors``.
BLOCK = 1 << 14


def vector_blocks(vector) -> pa.RecordBatch:
    """The blocks of a task's vector that are not all zero."""
    rows = [(i // BLOCK, vector[i : i + BLOCK].tobytes()) for i in range(0, vector.size, BLOCK) if vector[i : i + BLOCK].any()]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "data"])
