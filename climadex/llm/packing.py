"""Sequence packing as a cutting-stock problem, solved by column generation.

Documents are cut at multiples of the capacity; what remains of each is an item.  The
histogram of item lengths (in units of ``granularity`` tokens, so it has a bound that does
not depend on the input) is all that the driver sees:

* the restricted master is a linear program over patterns (how many items of each length
  share a sequence), solved by a revised simplex;
* an unbounded knapsack, solved by dynamic programming over the capacity, prices columns:
  the best pattern for the current duals enters until Farley's bound proves the plan close
  enough to the optimum;
* pattern counts are rounded down, the few items left over are packed best-fit decreasing.

Each item has a rank among those of its length, from per-task counts and a prefix sum over
tasks, and its rank tells its pattern, copy and slot.  Only a row per piece is shuffled.
"""

from __future__ import annotations

import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, texts_of
from .tokens import default_path, word_bpe


def _price(sizes: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most dual value that fits the capacity."""
    value, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sizes_up, duals_up = sizes[order], duals[order]
    fits = np.searchsorted(sizes_up, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        if k := fits[c]:
            gain = value[c - sizes_up[:k]] + duals_up[:k]
            j = int(gain.argmax())
            if gain[j] > value[c] + 1e-12:
                value[c], took[c] = gain[j], order[j]
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= int(sizes[took[c]])
    return float(value[capacity]), pattern


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Matrix times vector by numpy's own loops: a threaded BLAS beside a JVM can stall on matrices this small."""
    return np.einsum("ij,j->i", matrix, vector, optimize=False)


def _inverted(matrix: np.ndarray) -> np.ndarray:
    """Inverse by Gauss-Jordan with row pivots, without BLAS or LAPACK."""
    n = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(n)])
    for i in range(n):
        p = i + int(np.abs(work[i:, i]).argmax())
        if p != i:
            work[[i, p]] = work[[p, i]]
        work[i] /= work[i, i]
        factors = work[:, i].copy()
        factors[i] = 0
        rows = np.flatnonzero(factors)
        work[rows] -= factors[rows, None] * work[i]
    return work[:, n:]


def first_fit(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns of a first-fit decreasing packing, one per group of equal sequences."""
    left, out = demand.astype(np.int64).copy(), []
    while left.any():
        room, one = capacity, np.zeros(len(sizes), np.int64)
        for i in np.flatnonzero(left)[::-1]:
            if n := int(min(left[i], room // sizes[i])):
                one[i] = n
                room -= n * int(sizes[i])
        used = one > 0
        left -= int((left[used] // one[used]).min()) * one
        out.append(one.astype(float))
    return out


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, *, gap: float = 2e-3, most: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column for each of the basis) and how often each is used, fractional.

    The basis starts with one size per pattern; the patterns of a first-fit packing enter
    first, then those that the knapsack prices.  After ``most`` of these the plan so far is
    used, which still holds every item, and a warning states the gap left.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    x = _times(inverse, demand)
    pivots = 0

    def enter(column: np.ndarray) -> bool:
        nonlocal inverse, x, pivots
        towards = _times(inverse, column)
        up = towards > 1e-9
        if not up.any():
            return False
        ratios = np.full(m, np.inf)
        ratios[up] = x[up] / towards[up]
        leaves = int(ratios.argmin())
        row = inverse[leaves] / towards[leaves]
        inverse -= towards[:, None] * row
        inverse[leaves] = row
        basis[:, leaves] = column
        pivots += 1
        if pivots % 200 == 0:  # keep rounding errors from growing
            inverse = _inverted(basis)
        x = np.maximum(_times(inverse, demand), 0)
        return True

    for column in first_fit(sizes, demand, capacity):
        if (inverse.sum(axis=0) * column).sum() > 1 + 1e-9:
            enter(column)
    for _ in range(most):
        duals = np.maximum(inverse.sum(axis=0), 0)
        worth, column = _price(sizes, duals, capacity)
        # Farley: the optimum is at least sum(x) / worth, so at most this share (or one sequence) is to gain.
        if 1 - 1 / worth <= max(gap, 1 / max(x.sum(), 1)) or not enter(column):
            break
    else:
        warnings.warn(f"column generation stopped after {most} patterns, at most {1 - 1 / worth:.4f} of the sequences above the optimum", stacklevel=2)
    return basis, x


def plan(histogram: dict[int, int], capacity: int, **how) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: copies}) that hold each item of the histogram exactly once."""
    out = [(histogram[capacity], {capacity: 1})] if histogram.get(capacity) else []
    sizes = np.array(sorted(s for s, n in histogram.items() if s < capacity and n > 0), dtype=int)
    if not sizes.size:
        return out
    demand = np.array([histogram[int(s)] for s in sizes], float)
    patterns, x = column_generation(sizes, demand, capacity, **how)
    left = demand.astype(np.int64).copy()
    for j in np.argsort(-x):
        copies = patterns[:, j].astype(np.int64)
        used = copies > 0
        n = int(min(np.floor(x[j] + 1e-6), (left[used] // copies[used]).min() if used.any() else 0))
        if n > 0:
            left -= n * copies
            out.append((n, {int(sizes[i]): int(copies[i]) for i in np.flatnonzero(used)}))
    # Fewer sequences than sizes are left: fill one after the other with the largest that fit.
    while left.any():
        room, one = capacity, {}
        for i in np.flatnonzero(left)[::-1]:
            if n := int(min(left[i], room // sizes[i])):
                one[int(sizes[i])] = n
                left[i] -= n
                room -= n * int(sizes[i])
        out.append((1, one))
    return out


def _slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per size: first rank, sequence base, copies and first slot of each pattern that holds it."""
    held: dict[int, list] = {}
    ranks: dict[int, int] = {}
    base = 0
    for times, pattern in patterns:
        slot = 0
        for size, copies in sorted(pattern.items(), reverse=True):
            held.setdefault(size, []).append((ranks.get(size, 0), base, copies, slot))
            ranks[size] = ranks.get(size, 0) + times * copies
            slot += copies
        base += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows)) for s, rows in held.items()}


def pieces_of(docs: DataFrame, *, capacity: int, granularity: int, end_id: int, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """Tokenise and cut: a row per piece, with its size class, task and rank in the task."""

    def cut(batches):
        bpe, end, task = word_bpe(tokenizer_path), np.array([end_id], "<u2").tobytes(), TaskContext.get().partitionId()
        seen = np.zeros(capacity // granularity + 2, np.int64)
        for batch in slices(batches):
            rows = []
            for doc, b in zip(batch.column("doc_id").to_pylist(), bpe.encode(texts_of(batch))):
                ids = np.frombuffer(b + end, "<u2").astype("<u4")
                for start in range(0, ids.size, capacity):
                    part = ids[start : start + capacity]
                    size = -(-part.size // granularity)
                    raw = part.tobytes()
                    rows.append((doc, start, part.size, zlib.crc32(raw), ids.size, size, task, int(seen[size]), *([raw] if with_ids else [])))
                    seen[size] += 1
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", "task", "rank", "ids"][: len(kinds)])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, size int, task int, rank long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def pack_documents(
    docs: DataFrame,
    *,
    capacity: int = 2048,
    granularity: int = 8,
    end_id: int = 1,
    tokenizer_path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), a row per piece.

    Each id of each document (the end id included, so a null or empty text is one piece of
    one id) is in exactly one piece; pieces of a sequence follow each other from offset 0 and
    hold at most ``capacity`` ids.  ``ids`` are little-endian unsigned 32-bit integers.  Rows
    that repeat a doc_id, or have none, are packed like any other; other columns are left
    out.  An empty table gives an empty result.
    """
    if capacity % granularity:
        raise ValueError("granularity divides capacity")
    path = tokenizer_path or default_path("word_bpe_49k.json")
    pieces = stored(pieces_of(docs, capacity=capacity, granularity=granularity, end_id=end_id, tokenizer_path=path, with_ids=with_ids), "pieces")
    counts = pieces.groupBy("task", "size").agg(F.count(F.lit(1)).alias("n"))
    # At most capacity / granularity rows.
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan(histogram, capacity // granularity))
    # A size has a row per task here, not per item.
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).select("task", "size", F.coalesce("before", F.lit(0)).alias("before"))

    def assign(batches):
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "global_rank"))
            sequence, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, base, copies, place = slots[int(s)]
                j = np.searchsorted(first, rank[at], "right") - 1
                k = rank[at] - first[j]
                sequence[at] = base[j] + k // copies[j]
                slot[at] = place[j] + k % copies[j]
            names = [c for c in batch.schema.names if c not in ("size", "global_rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(slot)], [*names, "sequence_id", "slot"])

    ranked = pieces.join(before, ["task", "size"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", (F.col("rank") + F.col("before")).alias("global_rank"), *["ids"] * with_ids)
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    placed = ranked.mapInArrow(assign, f"{fields}, sequence_id long, slot long")
    w = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0))).drop("slot")
