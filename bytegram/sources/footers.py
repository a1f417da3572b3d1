"""Parquet footers of a listing: records of each file without reading them, and files grouped by their columns."""
from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .discovery import _python_files, _scheme, in_tasks

_SCHEMA = "path string, records long, columns string"


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    for batch in batches:
        for path, store in zip(*(c.to_pylist() for c in batch.columns)):
            with _python_files(store).open(path) as f:
                meta = pq.read_metadata(f)
            columns = json.dumps([[x.name, str(x.type)] for x in meta.schema.to_arrow_schema()])
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([meta.num_rows], pa.int64()), pa.array([columns])],
                                             names=["path", "records", "columns"])


def footers(spark: SparkSession, listing: DataFrame) -> DataFrame:
    """``path, records, columns`` of the Parquet files in ``listing (path, length)``.

    Tasks read the footers, a file each. A store that Python tasks don't reach is asked through Spark, file by file.
    """
    files = listing.filter(F.col("path").endswith(".parquet")).select("path")
    stores = [r[0] for r in files.select(F.regexp_extract("path", "^(?:file:/|[^:/]+://[^/]*/)", 0).alias("s")).distinct().collect()]
    out = spark.createDataFrame([], _SCHEMA)
    for store in map(_scheme, stores):
        mine = files.filter(F.startswith("path", F.lit(store)))
        if in_tasks(store):
            rows = mine.withColumn("store", F.lit(store)).repartition("path").mapInArrow(_by_task, _SCHEMA)
        else:
            frames = {r[0]: spark.read.parquet(r[0]) for r in mine.collect()}
            rows = spark.createDataFrame([(p, df.count(), df.schema.simpleString()) for p, df in frames.items()], _SCHEMA)
        out = out.unionByName(rows)
    return out


def column_groups(spark: SparkSession, listing: DataFrame) -> list[list[str]]:
    """The Parquet files of a listing, those with the same columns together: a group for each set of names and types."""
    some = [r[0] for r in listing.filter(F.col("path").endswith(".parquet")).select("path").take(2)]
    if len(some) < 2:
        return [some] if some else []
    groups = footers(spark, listing).groupBy("columns").agg(F.sort_array(F.collect_list("path")).alias("files"))
    return [r["files"] for r in groups.orderBy("columns").collect()]
