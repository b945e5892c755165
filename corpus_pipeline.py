"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Part of the training-data operators: it goes where ``climadex.llm`` goes.  Each stage takes
(spark, docs, sf_dir) and gets all rows that the stage before kept, with the columns of
``documents``; the last one returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from climadex.llm import decontam, line_dedup, packing, simhash, toxicity
from climadex.llm.common import scratch, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 10 documents or more go everywhere; every document stays."""
    return line_dedup.dedup_lines(docs, min_docs=10, min_chars=1, counts=False)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, shingle=4, seed=42, radius=4)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, capacity=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as tables:
        for i, (_, stage) in enumerate(STAGES[:-1]):
            docs = stored(stage(spark, docs, sf_dir), f"stage{i}")
            tables.clear(keep=tables.folders[-1:])  # only the stage's result is read from here on
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned models, a latent space and a linear program have no SQL; tests/llm/test_pipeline.py
#: compares all rows with plain versions of the stages, one after the other.
ORACLE_SQL = None
