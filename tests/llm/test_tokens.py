import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from climadex.llm import packing, token_counts, token_files
from climadex.llm.tokens import PieceCounter, WordBpe, default_path

from . import brute

BPE = WordBpe(default_path("word_bpe_49k.json"))
PIECES = PieceCounter(default_path("piece_bpe_32k.model"))
ODD = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("ab'.,  \n▁éÉß|<>st"))), max_size=60)


def ids(text):
    return BPE.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_word_bpe_is_the_library(text):
    assert np.frombuffer(BPE.encode([text])[0], "<u2").tolist() == ids(text)[:-1]


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_piece_counts_are_the_library(text):
    tokens = PIECES.pre_tokens(text)
    PIECES.learn(tokens)
    assert sum(PIECES.cache[t] for t in tokens) == len(PIECES.model.encode(text))


def test_cache_limit_changes_nothing(monkeypatch):
    import climadex.llm.tokens as tokens

    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 50)
    small = WordBpe(default_path("word_bpe_49k.json"))
    rng = random.Random(1)
    for _ in range(5):
        t = [brute.prose(rng, 80), "x" * 500]
        assert small.encode(t) == BPE.encode(t)


@pytest.mark.parametrize("how", [{}, {"broadcast_tokens": 0}, {"broadcast_tokens": 40, "filter_bits": 1 << 12}])
def test_count_tokens(spark, how):
    data = brute.rows()
    got = token_counts.count_tokens(brute.frame(spark, data), limit=100, **how).collect()
    want = sorted(((r[0] is not None, r[0] or 0, len((r[1] or "").encode()), len(PIECES.model.encode(r[1] or ""))) for r in data))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert token_counts.count_tokens(brute.frame(spark, []), **how).count() == 0


def test_each_pre_token_is_counted_once(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "HELD", 5)
    docs = brute.frame(spark, brute.rows())
    pieces = token_counts.pre_token_pieces(docs, default_path("piece_bpe_32k.model")).collect()
    want = {}
    for r in brute.rows():
        for t in set(PIECES.pre_tokens(r[1] or "")):
            want[t] = want.get(t, 0) + 1
    want = {t: n for t, n in want.items() if n > 1}
    assert {r["token"]: r["n_docs"] for r in pieces} == want and len(pieces) == len(want)


def test_a_plan_is_found_soon_whatever_the_threads():
    """The histogram of a small table, 200 sizes: without BLAS there is nothing to wait for."""
    import time

    rng = np.random.default_rng(2)
    histogram = {int(s): int(n) for s, n in zip(*np.unique(np.minimum(rng.geometric(0.01, 1200), 256), return_counts=True))}
    start = time.monotonic()
    plan = packing.plan(histogram, 256)
    assert time.monotonic() - start < 15
    held = {}
    for n, pattern in plan:
        assert sum(s * c for s, c in pattern.items()) <= 256
        for s, c in pattern.items():
            held[s] = held.get(s, 0) + n * c
    assert held == histogram
    least = sum(s * n for s, n in histogram.items()) / 256
    assert sum(n for n, _ in plan) <= 1.02 * least + 1
    with pytest.warns(UserWarning, match="stopped"):
        assert sum(n for n, _ in packing.plan(histogram, 256, most=3)) >= least


def test_token_files_round_trip(spark):
    data = brute.rows()
    folder, files = token_files.token_files(brute.frame(spark, data), length=64)
    got = token_files.read_token_files(spark, folder, files, with_ids=True).orderBy("start").collect()
    end = 0
    want = {}
    for r in data:
        want.setdefault(r[0], []).append(ids(r[1]))
    for r in got:
        assert r["start"] == end
        end += r["n_tokens"]
        assert r["ids"] in want[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    order = [r["doc_id"] for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:]) and len(order) == len(data)
    first = files.orderBy("start").first()
    x, mask = token_files.read_sequence(folder, first["path"], 0)
    assert len(x) == 64 and x.dtype == np.uint16
    stream = [i for r in got for i in r["ids"]]
    assert x[: min(64, first["n_tokens"])].tolist() == stream[: min(64, first["n_tokens"])]
    assert mask.to_pylist().count(True) == min(64, first["n_tokens"])


def test_token_files_of_an_empty_table(spark):
    folder, files = token_files.token_files(brute.frame(spark, []))
    assert files.count() == 0
    assert token_files.read_token_files(spark, folder, files).count() == 0


@pytest.mark.parametrize("capacity,granularity", [(256, 8), (64, 4)])
def test_packing_is_exact(spark, capacity, granularity):
    data = brute.rows()
    got = packing.pack_documents(brute.frame(spark, data), capacity=capacity, granularity=granularity, with_ids=True).collect()
    docs, sequences = {}, {}
    for r in got:
        x = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(x) == r["length"] and zlib.crc32(x.tobytes()) == r["ids_crc32"]
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], x.tolist()))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= capacity
    total = sorted(i for r in data for i in ids(r[1]))
    assert sorted(i for d in docs.values() for _, x in d for i in x) == total
    for (doc, n), pieces in docs.items():
        if doc not in (5, 6, None):
            assert [i for _, x in sorted(pieces) for i in x] == ids(data[doc][1]) and n == len(ids(data[doc][1]))
    assert len(sequences) * capacity < 1.35 * len(total)


def test_packing_of_an_empty_table(spark):
    assert packing.pack_documents(brute.frame(spark, [])).count() == 0


def test_plans_hold_the_demand_and_waste_little():
    rng = np.random.default_rng(2)
    sizes, counts = np.unique(rng.integers(1, 64, 3000), return_counts=True)
    histogram = {int(a): int(b) for a, b in zip(sizes, counts)} | {64: 5}
    got = packing.plan(histogram, 64)
    held = {}
    for times, pattern in got:
        assert sum(s * c for s, c in pattern.items()) <= 64
        for s, c in pattern.items():
            held[s] = held.get(s, 0) + times * c
    assert held == histogram
    n = sum(t for t, _ in got)
    assert n * 64 <= 1.03 * sum(s * c for s, c in histogram.items()) + 64


def test_a_hot_length_is_ranked_without_a_gap(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("the same words").alias("text")).repartition(9)
    got = packing.pack_documents(docs, capacity=64).collect()
    assert len(got) == 500 and len({(r["sequence_id"], r["offset"]) for r in got}) == 500
