import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from climadex.llm import edit_embedding, line_dedup, simhash
from climadex.llm.components import connected_components

from . import brute

#: MB that a worker may keep after a task, with its modules.
KEPT_MB = 95

KEY = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize("how", [{}, {"broadcast_keys": 0}, {"filter_bits": 1 << 16}])
def test_line_dedup_matches_brute_force(spark, how):
    data = brute.rows()
    out = line_dedup.dedup_lines(brute.frame(spark, data), **how)
    assert [c for c in out.columns if c not in ("n_lines", "n_dropped")] == [c for c in brute.SCHEMA.names if c != "n_lines"]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()]
    want = brute.dedup(data)
    assert sum(x[2] for x in want) >= 12
    assert sorted(got, key=KEY) == sorted(want, key=KEY)


def test_line_dedup_keeps_first_occurrence(spark):
    docs = spark.createDataFrame([(3, "x\nsame\nsame"), (1, "Same \ny"), (2, "same")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, min_docs=2, keep="first").collect()}
    assert out == {1: "Same \ny", 2: "", 3: "x"}
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(docs, keep="last")


@pytest.mark.parametrize("how", [{}, {"broadcast_keys": 0}])
def test_line_dedup_without_counts_leaves_the_columns(spark, how):
    docs = brute.frame(spark, brute.rows())
    out = line_dedup.dedup_lines(docs, counts=False, **how)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] is not None) == sorted((r[0], r[3]) for r in brute.dedup(brute.rows()) if r[0] is not None)
    assert {r["n_lines"] for r in out.collect()} == {7, None}


def test_filter_size_follows_the_input_and_keys_do_not_depend_on_parts(spark, monkeypatch):
    docs = brute.frame(spark, brute.rows())
    assert line_dedup.filter_bits_for(docs) == line_dedup.LEAST_BITS
    want = sorted(map(tuple, line_dedup.repeated_keys(docs, min_docs=2).collect()))
    monkeypatch.setattr(line_dedup, "HELD", 1)
    assert sorted(map(tuple, line_dedup.repeated_keys(docs, min_docs=2).collect())) == want


def test_line_dedup_empty_table(spark):
    assert line_dedup.dedup_lines(brute.frame(spark, [])).count() == 0


def test_twice_filter_has_no_false_negative(spark):
    lines = [f"line {i % 500}" for i in range(1000)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").repartition(7)
    keys = line_dedup.repeated_keys(docs, min_docs=2, filter_bits=1 << 18)
    assert keys.count() == 500
    assert {r["n_docs"] for r in keys.collect()} == {2}


def _kept_mb(spark, name, run):
    """Most memory that a Python worker of its own environment keeps after ``run``."""
    env = spark.sparkContext.environment
    env["CLIMADEX_TEST"] = name

    def kept(batches):
        for batch in batches:
            time.sleep(1)  # so that all workers take part
            with open("/proc/self/status") as f:
                kb = next(int(x.split()[1]) for x in f if x.startswith("RssAnon"))
            yield pa.RecordBatch.from_arrays([pa.array([kb], pa.int64())], ["kb"])

    try:
        run()
        return max(r["kb"] for r in spark.range(4, numPartitions=4).mapInArrow(kept, "kb long").collect()) / 1024
    finally:
        del env["CLIMADEX_TEST"]


def _long_table(spark):
    """About 40 MB of text, in one partition."""
    line = F.concat(F.lit("line "), F.col("id"), F.lit(" of some words and a number "), F.col("x"))
    rows = spark.range(0, 12000, 1, 1).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(80)))).select("id", line.alias("line"))
    return rows.groupBy(F.col("id").alias("doc_id")).agg(F.array_join(F.collect_list("line"), "\n").alias("text")).coalesce(1)


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="reads /proc")
def test_workers_of_line_dedup_keep_no_memory(spark):
    docs = _long_table(spark)
    run = lambda: line_dedup.dedup_lines(docs, min_docs=2).write.format("noop").mode("overwrite").save()
    assert _kept_mb(spark, "line_dedup", run) < KEPT_MB


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="reads /proc")
def test_workers_of_edited_fingerprints_keep_no_memory(spark):
    docs = _long_table(spark)
    run = lambda: edit_embedding.edited_fingerprints(docs).write.format("noop").mode("overwrite").save()
    assert _kept_mb(spark, "edit_embedding", run) < 80


def test_shards_are_merged_in_any_order():
    rng = np.random.default_rng(3)
    once, twice, seen = np.zeros(64, np.uint8), np.zeros(64, np.uint8), np.zeros(512, int)
    for k in (3, 200, 10, 16, 400, 5):
        a = rng.choice(512, k, replace=False)
        block = line_dedup._block(a, 9)
        line_dedup._add(line_dedup._block(a[: k // 4], 9), twice)
        line_dedup._add(block, once, (once, twice))
        seen[a] += 1
        seen[a[: k // 4]] += 1
    assert (np.unpackbits(twice) == (seen > 1)).all() and (np.unpackbits(once) == (seen > 0)).all()


def test_merging_shards_takes_no_sort(spark, monkeypatch):
    docs = brute.frame(spark, brute.rows())
    plans = []
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
    line_dedup.twice_filter(docs, 1, line_dedup.LEAST_BITS)
    assert len(plans) == 1 and "Sort" not in plans[0]


def test_simhash_matches_brute_force(spark):
    data = brute.rows()
    got = simhash.near_duplicates(brute.frame(spark, data)).collect()
    assert len(got) == len(data)
    fps = {}
    for r in data:
        fps.setdefault(r[0], set()).add(brute.simhash(r[1]))
    for r in got:
        assert int(r["fingerprint"], 16) in fps[r["doc_id"]]
    fps.pop(None)
    want = brute.components(fps, lambda i, j: any((a ^ b).bit_count() <= 4 for a in fps[i] for b in fps[j]))
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)
    assert len(set(want.values())) < len(want)


def test_simhash_empty_table_and_dropping(spark):
    assert simhash.near_duplicates(brute.frame(spark, [])).count() == 0
    docs = brute.frame(spark, brute.rows())
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert 20 in ids and 21 not in ids and None in ids
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})


def test_one_row_stays_of_a_repeated_one(spark):
    data = [(7, "one text of some words here", "en"), (7, "one text of some words here", "fr"), (7, "one text of some words here", "en"), (9, "something else altogether, is it not", "de")]
    docs = spark.createDataFrame(data, "doc_id int, text string, `meta.url` string").repartition(3)
    got = simhash.drop_near_duplicates(docs)
    assert got.dtypes == docs.dtypes and sorted(r["doc_id"] for r in got.collect()) == [7, 9]


def test_bucket_kernels_agree_with_distances():
    rng = np.random.default_rng(0)
    for n, radius in ((40, 4), (300, 4), (300, 2), (700, 7)):
        base = rng.integers(0, 1 << 63, 6, dtype=np.int64).astype(np.uint64)
        fps = base[rng.integers(0, 6, n)]
        for k in range(5):
            flip = rng.random(n) < 0.5
            fps[flip] ^= np.uint64(1) << rng.integers(0, 64, flip.sum(), dtype=np.int64).astype(np.uint64)
        want = brute.components(range(n), lambda i, j: (int(fps[i]) ^ int(fps[j])).bit_count() <= radius)
        reps = np.arange(n, dtype=np.int64)
        for key in (np.zeros(n, np.int64), None):
            if key is None:  # the same lanes as a small bucket's kernel sees them
                if n > simhash.SMALL:
                    continue
            labels = simhash._large_bucket(fps, radius)
            a, b = simhash._bucket_links(fps, reps, np.zeros(n, np.int64), radius)
            assert {tuple(sorted(np.flatnonzero(labels == x))) for x in set(labels)} == {tuple(i for i in want if want[i] == c) for c in set(want.values())}
            assert {(int(x), int(y)) for x, y in zip(a, b)} == {(i, c) for i, c in want.items() if i != c}


def test_links_of_every_near_pair_are_found(spark):
    rng = random.Random(5)
    fps = []
    for i in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        fps += [x, y]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    classes = spark.createDataFrame(list(zip(signed, range(400))), "fp long, rep long")
    links = {(r["a"], r["b"]) for r in simhash.fingerprint_links(classes).collect()}
    assert {(2 * i + 1, 2 * i) for i in range(200)} <= links


def test_links_do_not_depend_on_blocks_nor_on_large_buckets(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 5)
    fps = np.unique(np.concatenate([base[rng.integers(0, 5, 600)] ^ (1 << rng.integers(0, 62, 600)) ^ (1 << rng.integers(0, 62, 600)), rng.integers(0, 1 << 62, 300)]))
    classes = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps)], "fp long, rep long")
    want = brute.components(range(len(fps)), lambda i, j: (int(fps[i]) ^ int(fps[j])).bit_count() <= 4)
    for how in ({}, {"blocks": 7}, {"large": 20}):
        parts = {r["node"]: r["component"] for r in connected_components(simhash.fingerprint_links(classes, **how)).collect()}
        assert {i: parts.get(i, i) for i in range(len(fps))} == want
    assert simhash.blocks_for(10**5, 4) <= simhash.blocks_for(10**8, 4) < simhash.blocks_for(10**11, 4)


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100)]
    hub = [(1000, 1000 + i) for i in range(1, 200)]
    links = spark.createDataFrame([*chain, *hub, (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[1000 + i] == 1000 for i in range(200))
    assert connected_components(links.where("false")).count() == 0


def test_fingerprints_are_those_of_a_plain_walk(spark):
    """The query's fingerprints against a walk that takes one character after the other."""
    e = edit_embedding
    data = [r for r in brute.rows() if len(r[1] or "") < 6000]
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in order]
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, texts[1:] + texts[:1])]

    def plain(text):
        scale = max(1, 2 * len(text)).bit_length() - 1
        slots = []
        for k in (scale, scale + 1):
            steps = [int(p) for p in e._sampled(k)]
            got = brute.walk(text, e._MOVES, e._SYMBOL, e._classes, e.END, steps)
            slots.append(got + [0] * (e.SAMPLES - len(got)))
        return f"{scale:02x}" + "".join(f"{x:x}" for s in slots for x in s)

    got = e.edited_fingerprints(brute.frame(spark, data)).collect()
    want = sorted((r[0] is not None, r[0] or 0, plain(t), plain(n)) for r, t, n in zip(order, texts, edited))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["fingerprint"], r["edited_fingerprint"]) for r in got) == want


def test_edited_fingerprints(spark):
    data = brute.rows()
    got = edit_embedding.edited_fingerprints(brute.frame(spark, data)).collect()
    assert len(got) == len(data)
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in order]
    rows = {}
    for r in got:
        rows.setdefault((r["doc_id"], r["edited"]), r)
    near, far = [], []
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        k = len(t) // 4
        edited = t[: len(t) - k] + following[:k]
        r = rows[order[i][0], edited]
        assert r["n_chars"] == len(t)
        s, x = edit_embedding.embed([t, edited, following])
        assert r["fingerprint"] == edit_embedding.to_text(int(s[0]), x[0])
        assert r["edited_fingerprint"] == edit_embedding.to_text(int(s[1]), x[1])
        assert r["near_edited"] == edit_embedding.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert 0 <= r["near_next"] <= 1 and (t != following or r["near_next"] == 1)
        if len(t) > 200 and t != following and edited != t:
            near.append(r["near_edited"])
            far.append(r["near_next"])
    assert min(near) > max(f for f in far if f < 0.9)


def test_edited_fingerprints_of_few_rows(spark):
    assert edit_embedding.edited_fingerprints(brute.frame(spark, [])).count() == 0
    one = spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")
    r = edit_embedding.edited_fingerprints(one).first()
    assert (r["edited"], r["near_next"]) == ("abcdefab", 1.0)


def test_insertions_keep_fingerprints_close(spark):
    rng = random.Random(1)
    t = brute.prose(rng, 400)
    shifted = "xyz " + t
    s, x = edit_embedding.embed([t, shifted, brute.prose(rng, 400)])
    fp = [edit_embedding.to_text(int(a), b) for a, b in zip(s, x)]
    assert edit_embedding.likeness(fp[0], fp[1]) > 0.8 > 0.4 > edit_embedding.likeness(fp[0], fp[2])


def test_edit_duplicates(spark):
    rng = random.Random(2)
    texts = [brute.prose(rng, 120) for _ in range(30)]
    texts += [t[:100] + "Z" + t[101:] for t in texts[:10]] + [texts[3], "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in edit_embedding.edit_duplicates(docs).collect()}
    assert all(got[30 + i] == i for i in range(10)) and got[40] == 3 and got[41] == got[42] == 41
    assert all(got[i] == i for i in range(30))
    # Rows of one doc_id, of a null one, and none at all.
    more = docs.unionByName(spark.createDataFrame([(5, texts[7]), (None, texts[5])], docs.schema))
    again = {(r["doc_id"], r["component_id"]) for r in edit_embedding.edit_duplicates(more).collect()}
    assert {(5, 5), (7, 5), (35, 5), (37, 5), (6, 6), (None, None)} <= again and len(again) == len(texts) + 1
    rows = edit_embedding.edited_fingerprints(more, least=0.8).collect()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == again and len(rows) == len(texts) + 2
    assert edit_embedding.edit_duplicates(docs.where("doc_id < 0")).count() == 0
    assert edit_embedding.edited_fingerprints(docs.where("doc_id < 0"), least=0.8).count() == 0
    known = edit_embedding.fingerprints(docs).groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").count()
    assert known >= 2


def test_edit_duplicates_do_not_depend_on_the_size_of_buckets(spark):
    rng = random.Random(5)
    base = brute.prose(rng, 150)
    texts = [brute.prose(rng, 150) for _ in range(10)]
    texts += [base[:k] + "#" + base[k + 1 :] for k in range(5, 145, 4)] + texts[:4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = {r["doc_id"]: r["fingerprint"] for r in edit_embedding.fingerprints(docs).collect()}
    want = {i: i for i in fps}
    for i in want:
        for j in range(i):
            if want[i] != want[j] and edit_embedding.likeness(fps[i], fps[j]) >= 0.8:
                low, high = sorted((want[i], want[j]))
                want = {k: low if v == high else v for k, v in want.items()}
    assert sum(v == 10 for v in want.values()) > 30  # one group, larger than a bucket below may be
    told = edit_embedding.edited_fingerprints(docs, least=0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in told} == want
    for large in (8192, 6):
        assert {r["doc_id"]: r["component_id"] for r in edit_embedding.edit_duplicates(docs, large=large).collect()} == want


def test_an_appended_half_is_unequal(spark):
    rng = random.Random(17)
    for n in (100, 1000, 9000):
        x = brute.prose(rng, n)[:n]
        y = x + " " + brute.prose(rng, n)[: n + n // 25]
        scales, samples = edit_embedding.embed([x, y])
        a, b = (edit_embedding.to_text(int(k), v) for k, v in zip(scales, samples))
        assert 0.35 < edit_embedding.likeness(a, b) == edit_embedding.likeness(b, a) < 0.65
    docs = spark.createDataFrame([(1, x), (2, y), (3, x + " z")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in edit_embedding.edit_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
