"""Incremental ingest: new source files in a folder become new shards of a corpus table.

A Structured Streaming file source tracks which files were already taken (its checkpoint is the resume
manifest). Every micro-batch is laid out as one new shard whose id is derived from the batch id, and is
written with dynamic partition overwrite, so a retried batch rewrites the same shard instead of adding a
copy. ``doc_ix`` continues after the documents of all earlier shards.

The stream reads JSON-lines sources only. A Parquet source in the folder is not left out in silence: the ingest does not
start, and a batch that finds one fails before it writes.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import layout as LY
from ..sources import records as RC


def _existing(spark: SparkSession, corpus_path: str, below_shard: int) -> int:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(corpus_path)
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return 0  # only a table that isn't there yet is empty; any other failure stops the batch
    return int(spark.read.parquet(corpus_path).filter(F.col("shard") < below_shard).count())


def _no_parquet(spark: SparkSession, source_dir: str) -> None:
    """Fail if there are sources in the folder, or below it, that the stream would leave out."""
    left = RC.list_sources(spark, source_dir).filter(F.col("path").endswith(".parquet") | F.col("path").rlike(r"/[_.][^/]*$")).take(1)
    if left:
        raise ValueError(f"the stream cannot ingest {left[0]['path']}: a Parquet source, or a name that Spark's readers skip")


def ingest_stream(spark: SparkSession, source_dir: str, corpus_path: str, checkpoint_dir: str,
                  text_key: str = "text", available_now: bool = True, max_files_per_batch: int | None = None):
    """Start the ingest query; returns the ``StreamingQuery``. Each batch → one shard."""
    root = RC.qualify(source_dir).rstrip("/") + "/"
    _no_parquet(spark, source_dir)
    reader = spark.readStream.format("text").option("pathGlobFilter", "*.{jsonl,json.gz,zst,zstd}").option("recursiveFileLookup", "true")
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    lines = reader.load(source_dir).select(
        RC.file_path_col().alias("_abs"), F.col("_metadata.file_block_start").alias("_blk"), "value")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        _no_parquet(spark, source_dir)
        recs = RC.parse_jsonl_lines(batch, root, text_key)
        shard = int(batch_id)
        base = _existing(spark, corpus_path, shard)
        docs = LY.global_doc_index(recs)
        docs = docs.select((F.col("doc_ix") + F.lit(base)).alias("doc_ix"), "path", "linenum", "text",
                           RC.metadata_envelope(docs).alias("metadata"), F.lit(shard).alias("shard"))
        lay = LY.explicit_shards(docs)
        from ..plans.corpus import CORPUS_COLUMNS
        (lay.select(*CORPUS_COLUMNS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("shard").parquet(corpus_path))

    w = lines.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
