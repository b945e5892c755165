import os

import pyarrow as pa

from climadex.llm.common import bucket_of, doc_buckets, free_name, ranges, release, sampled_rows, scratch, shared_dir, slices, stored, without_ids


def test_stored_tables_are_released(spark):
    df = stored(spark.range(5), "numbers")
    folder = os.path.dirname(shared_dir(spark)).removeprefix("file://")
    assert sorted(r["id"] for r in df.collect()) == list(range(5)) and os.listdir(folder)
    release(spark)
    assert not os.path.exists(folder)


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n else None for n in (5, 0, 9, 30, 1, 1)])], ["text"])
    parts = list(slices([batch], most=10))
    assert [p.column(0).to_pylist() for p in parts] == [["a" * 5, None], ["a" * 9], ["a" * 30], ["a", "a"]]


def test_buckets_are_ranges(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    bounds = doc_buckets(df, 8)
    sizes = [r["count"] for r in df.groupBy(bucket_of(df["doc_id"], bounds).alias("b")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 200
    for n in (2, 3, 50, 101):
        bounds = doc_buckets(df, n)
        got = {r["doc_id"]: r["b"] for r in df.select("doc_id", bucket_of(df["doc_id"], bounds).alias("b")).collect()}
        assert got == {i: sum(b <= i for b in bounds) for i in range(1000)}
    assert ranges(df) >= 4
    assert doc_buckets(df.where("false"), 8) == []


def test_without_ids_keeps_rows_that_have_none(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    ids = spark.createDataFrame([(2,), (2,), (None,)], "doc_id long")
    assert sorted(r["text"] for r in without_ids(df, ids).collect()) == ["a", "d"]
    odd = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "doc_id int, `meta.url` string, __id int")
    kept = without_ids(odd, ids)
    assert kept.columns == odd.columns and [tuple(r) for r in kept.collect()] == [(1, "a", 1)]
    assert free_name(["__ID", "__id_"], "__id") == "__id__"


def test_scratch_clears_what_was_stored_inside(spark):
    with scratch(spark) as s:
        one, two = stored(spark.range(3), "one"), stored(spark.range(4), "two")
        first, last = [f.removeprefix("file://") for f in s.folders]
        s.clear(keep=s.folders[-1:])
    assert not os.path.exists(first) and os.path.exists(last) and two.count() == 4


def test_samples_are_bounded_whatever_repeats(spark):
    """100 000 rows of one id, beside 3000 of others; a language each, or none."""
    hot = spark.range(100_000).selectExpr("5L as doc_id", "concat('t', id % 3) as text", "'en' as lang")
    others = spark.range(10, 3010).selectExpr("id as doc_id", "concat('x', id) as text", "if(id % 3 = 0, 'fr', 'en') as lang")
    nothing = spark.sql("select cast(null as long) as doc_id, 'n' as text, 'en' as lang")
    rows = hot.unionByName(others).unionByName(nothing)
    got = sampled_rows(rows, 300, "s").collect()
    assert 200 < len(got) < 400 and len({r["doc_id"] for r in got}) == len(got)
    got = sampled_rows(rows, 300, "s", by="lang").collect()
    assert all(200 < sum(r["lang"] == x for r in got) < 400 for x in ("en", "fr"))
    everything = sampled_rows(rows, 5000, "s").collect()
    assert len(everything) == 3001 and [r["text"] for r in everything if r["doc_id"] == 5] == ["t0"]
    assert sampled_rows(rows.where("false"), 5, "s", by="lang").count() == 0
