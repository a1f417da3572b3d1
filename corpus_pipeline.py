"""Training-corpus pipeline: five stages from ``documents`` to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; its result is written as Parquet
and read again. All but the last return the columns of ``documents``. No stage drops a row for lack of an id: a row is
known by its id and the hash of its text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegram.llm import decontam, packing, quality_rules, queries, simhash, suffix_dedup
from bytegram.llm.common import only, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _same_row(docs: DataFrame, other: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(other["doc_id"]) & (F.xxhash64(docs["text"]) == other["text_hash"])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    docs = only(docs, COLUMNS)
    kept = quality_rules.quality(docs).filter("kept").select("doc_id", "text_hash").distinct()
    return docs.join(kept, _same_row(docs, kept), "left_semi")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that with the smallest id."""
    docs = only(docs, COLUMNS)
    kept = simhash.near_duplicates(docs, shingle=4, max_bits=4).filter("kept").select("doc_id", "text_hash").distinct()
    return docs.join(kept, _same_row(docs, kept), "left_semi").dropDuplicates(["doc_id", "text"])


def repeated_text_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 200 bytes that also start elsewhere; parts of cut characters go."""
    left = suffix_dedup.remove_repeats(only(docs, COLUMNS), length=200, with_text=True, carry=("lang", "source"))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    docs = only(docs, COLUMNS)
    leaks = decontam.contaminated(docs, queries.benchmark(spark, sf_dir)).select("doc_id", "text_hash").distinct()
    return docs.join(leaks, _same_row(docs, leaks), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of 2048."""
    return packing.pack_documents(only(docs, COLUMNS), queries._tokenizer("byte_bpe_50k.json"), keep_space=True,
                                  end_id=0, capacity=2048)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeated_text_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: Quality references, fingerprints and repeated strings have no practical SQL: the tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = table("documents")(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
