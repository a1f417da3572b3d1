"""Resumable ingest: pending source files become shards of a corpus table, one after the other, with a log of what is done.

The log is an append-only table below the corpus table (``_log``, which scans of the table skip): a row for each file
with its size, its shard and the shard's documents, written when the shard is. A run that dies leaves at most one shard
without log rows; the next run gives the same number to the first shard it writes, whose folder it overwrites whole. So
every file is in the table once, however often runs die. A file that has grown or shrunk since counts as new and is an error,
because its old records are in the table already.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import layout as LY
from ..sources import records as RC
from .corpus import CORPUS_COLUMNS

LOG = "path string, length bigint, shard int, shard_docs bigint"


def done(spark: SparkSession, corpus_path: str) -> DataFrame:
    """``path, length, shard, shard_docs`` of all files whose shards are finished."""
    try:
        return spark.read.schema(LOG).parquet(f"{corpus_path}/_log/files")
    except AnalysisException:
        return spark.createDataFrame([], LOG)


def plan_shards(listing: DataFrame, bytes_per_shard: int) -> DataFrame:
    """``path, length, part``: files in path order, cut into runs of about ``bytes_per_shard`` bytes (one file at least).

    Only names and sizes go through the window.
    """
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum("length").over(before), F.lit(0)) / bytes_per_shard)
    return listing.select("path", "length", part.alias("_part")).select(
        "path", "length", (F.dense_rank().over(Window.orderBy("_part")) - 1).alias("part"))


def pending(spark: SparkSession, sources: list[str] | str, corpus_path: str) -> DataFrame:
    """``path, length`` of the sources that no finished shard holds. Raises if a finished file has another size by now."""
    listing, finished = RC.list_sources(spark, sources), done(spark, corpus_path)
    changed = listing.join(finished.select("path", F.col("length").alias("_then")), "path").filter("length <> _then").take(1)
    if changed:
        raise ValueError(f"{changed[0]['path']} had {changed[0]['_then']} bytes when it was ingested, and has {changed[0]['length']} now")
    return RC.pending_sources(listing, finished)


def ingest(spark: SparkSession, sources: list[str] | str, corpus_path: str, bytes_per_shard: int = 1 << 30,
           text_key: str = "text", on_bad: str = "fail", meta_key: str | None = None, root: str | None = None) -> Iterator[int]:
    """Write the pending files of ``sources`` as new shards; yields each shard's number when its log row is written.

    All accepted endings and subfolders are taken. Document numbers go on after those of earlier shards. ``root`` is
    what paths are relative to; by default the deepest folder that holds all sources listed now.
    """
    listing = pending(spark, sources, corpus_path)
    if listing.isEmpty():
        return
    root = root or RC.common_root(RC.list_sources(spark, sources))
    parts = plan_shards(listing, bytes_per_shard).checkpoint()
    for part in range(parts.agg(F.max("part")).first()[0] + 1):
        finished = done(spark, corpus_path).select("shard", "shard_docs").distinct()
        shard, base = finished.agg(F.coalesce(F.max("shard") + 1, F.lit(0)), F.coalesce(F.sum("shard_docs"), F.lit(0))).first()
        files = parts.filter(F.col("part") == part).select("path", "length")
        docs = LY.global_doc_index(RC.read_listing(spark, files, root, text_key, on_bad, meta_key))
        docs = docs.select((F.col("doc_ix") + F.lit(base)).alias("doc_ix"), "path", "linenum", "text",
                           RC.metadata_envelope(docs).alias("metadata"), F.lit(shard).alias("shard"))
        (LY.explicit_shards(docs).select(*CORPUS_COLUMNS).sortWithinPartitions("doc_ix")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(corpus_path))
        n = spark.read.parquet(f"{corpus_path}/shard={shard}").count()
        (files.select("path", "length", F.lit(shard).alias("shard"), F.lit(n).cast("bigint").alias("shard_docs"))
         .coalesce(1).write.mode("append").parquet(f"{corpus_path}/_log/files"))
        yield shard
