"""Written tables in the shared folder, and helpers that several operators need."""
from __future__ import annotations

import gc
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegram.session import checkpoint_root

#: Words are runs of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(name: str):
    """Reader of one of the given tables."""
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that all executors share (``spark.checkpoint.dir``)."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """The rows of ``df``, written once to the shared folder: later readers survive lost executors.

    ``batch_rows`` sets how many rows Python functions in ``df`` get at a time, where rows are long.
    """
    spark = df.sparkSession
    path, key = shared(spark, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if batch_rows:
        spark.conf.set(key, batch_rows)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps, as it does when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sorted_join(df: DataFrame) -> DataFrame:
    """``df`` for a join that sorts both sides, and never broadcasts one. Spark sizes a written table by its packed files, and what is
    exploded as if it were not, so that it may take for small what does not fit the driver."""
    return df.hint("merge")


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``written`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def only(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Just these columns, each by its own name: extra columns with clashing names fall away."""
    return df.select(*[F.col(c) for c in columns])


def fold(df: DataFrame, divisor: int, remainder: int, key: str = "doc_id") -> Column:
    """True where crc32 of the key's text has this remainder (null key: false)."""
    return F.coalesce(F.crc32(df[key].cast("string").cast("binary")) % divisor == remainder, F.lit(False))
