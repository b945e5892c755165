import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from climadex.llm import queries

from . import brute
from .test_learned import INSULTS, toxic_docs


def test_every_query_is_named_after_its_operator():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert names == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_stages_take_effect_in_order(spark, tmp_path):
    docs, labels = toxic_docs(300)
    docs = [(i, t) for i, t in docs if i is not None and i <= 300][:301]
    item = "an item of the benchmark with words " + brute.prose(__import__("random").Random(5), 30)
    docs += [(400, docs[1][1]), (401, docs[2][1] + "\n" + item)]
    docs = [(i, (t or "") + ("\na shared line" if 10 <= i < 30 else "")) for i, t in docs]
    schema = "doc_id long, text string"
    spark.createDataFrame(docs, schema).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert 401 not in ids and 400 not in ids and 1 in ids
    toxic = {i for i, t in docs if set(t.split()) & set(INSULTS)}
    assert len(ids & toxic) <= 0.1 * len(toxic)
    clean = {i for i, t in docs if i not in toxic and i not in (400, 401)}
    assert ids >= clean - {300}
    want = {i: t.removesuffix("\na shared line") for i, t in docs}
    from .test_tokens import ids as encode

    one = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got if r["doc_id"] == 11)
    import numpy as np

    x = np.array(encode(want[11]), "<u4")
    assert one == [(0, len(x), zlib.crc32(x.tobytes()), len(x))]


def test_run_is_what_plain_versions_of_the_stages_give(spark, tmp_path):
    """All rows of ``run`` against the stages one after the other in plain Python."""
    import random

    import numpy as np

    from climadex.llm import toxicity

    from .test_tokens import ids as encode

    rng = random.Random(15)
    docs, labels = toxic_docs(150)
    docs = [(i, t) for i, t in docs if i is not None and i < 150]
    items = [(1, brute.prose(rng, 30)), (2, brute.prose(rng, 9)), (3, "just four words here")]
    near = docs[7][1].split(" ")
    docs += [(200, docs[1][1]), (201, " ".join([*near[:3], "other", *near[4:]])), (202, docs[2][1] + "\n" + items[0][1]), (203, items[1][1] + " and more"), (204, "so just four words here"), (205, None), (206, "")]
    docs += [(300, " ".join(brute.prose(rng, 9000).split()))]
    docs = [(i, t + "\na shared line" if t and 10 <= i < 25 else t) for i, t in docs]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, `n.chars` long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([x for x in labels if x[0] is None or x[0] < 150], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.train(table, spark.read.parquet(str(tmp_path / "labels.parquet")))
    rows = [(i, t) for i, t in docs if brute.toxicity(t, model, toxicity.PATTERNS) < 0.5]
    assert 100 < len(rows) < len(docs) - 10
    rows = [(i, t) for i, _, _, t in brute.dedup(rows)]
    fps = {i: brute.simhash(t) for i, t in rows}
    part = brute.components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    rows = [(i, t) for i, t in rows if part[i] == i]
    rows = [(i, t) for i, t in rows if len(t) > 20_000 or not any(brute.leaked(t, x) for _, x in items)]
    assert {200, 202, 203, 204, 206} & {i for i, _ in rows} == set() and 205 in {i for i, _ in rows}
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == {i for i, _ in rows}
    for i, t in rows:
        x, at = np.array(encode(t), "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = x[at : at + r["length"]]
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(part.tobytes()), len(x)) and part.size == r["length"]
            at += r["length"]
        assert at == len(x)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= sum(r["length"] for r in got) / 2048 * 1.02 + 2
