"""Write JSON-lines source files derived from a table (for ingest tests and registered checks).

Spark's text writer names files ``part-….txt[.gz|.zst]``; the accepted endings are fixed, so the files
are renamed through the Hadoop file system (a metadata operation on the driver), to ``docs`` with the ending.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import part_count, scratch_path

#: The folder of a null or empty value, as Spark's writer names it.
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
FORMATS = {
    "jsonl": (None, ".txt", ".jsonl"),
    "gz": ("gzip", ".txt.gz", ".json.gz"),
    "zst": (None, None, ".zst"),
}


def _rename_parts(spark: SparkSession, path: str, old: str, new: str) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    it = fs.listFiles(root, True)
    while it.hasNext():
        p = it.next().getPath()
        name = p.getName()
        if name.startswith("part-") and name.endswith(old):
            # all lines of a folder come from one task, and so from one file
            fs.rename(p, jvm.org.apache.hadoop.fs.Path(p.getParent(), "docs" + new))


def _local(path: str) -> str | None:
    """The folder that a path of a POSIX-mounted store names."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def _copy_parts(folders, parts: str, path: str, fmt: str) -> None:
    """In a task: the part files of each folder, one behind the other in order of their names, as that folder's file."""
    import os
    import shutil
    import uuid
    from urllib.parse import unquote

    import zstandard
    for (folder,) in folders:
        name, _, value = folder.partition("=")
        # Spark's writer escapes a value; zstd folders have it as it is
        out = folder if fmt != "zst" else f"{name}={'' if value == _NO_VALUE else unquote(value)}"
        os.makedirs(os.path.join(path, out), exist_ok=True)
        new = os.path.join(path, out, f".{uuid.uuid4().hex}")
        with open(new, "wb") as fh:
            to = zstandard.ZstdCompressor().stream_writer(fh, closefd=False) if fmt == "zst" else fh
            for part in sorted(x for x in os.listdir(os.path.join(parts, folder)) if x.startswith("part-")):
                with open(os.path.join(parts, folder, part), "rb") as f:
                    shutil.copyfileobj(f, to, 1 << 20)
            if to is not fh:
                to.close()
        # a whole file takes its name, so that a task that runs again changes nothing
        os.replace(new, os.path.join(path, out, "docs" + FORMATS[fmt][2]))


def write_jsonl(spark: SparkSession, df: DataFrame, path: str, fmt: str, file_col: str, order_col: str,
                record: F.Column) -> str:
    """One file per value of ``file_col`` (a ``file_col=value`` folder), lines ordered by ``order_col``.

    Lines are sorted in parts of bounded size, so that a large file is not one task's sort; a task for each file then copies its
    parts in blocks (compressing zstd, which needs a native Hadoop codec to write). A store that is not mounted has its files
    written by a task each, without zstd.
    """
    codec, old, new = FORMATS[fmt]
    local = _local(path)
    if fmt == "zst" and local is None:
        raise NotImplementedError("zstd sources can only be derived into a POSIX-mounted folder")
    name = F.coalesce(F.col(file_col).cast("string"), F.lit("None")).alias(file_col) if fmt == "zst" else F.col(file_col)
    lines = df.select(name, F.col(order_col), record.alias("value"))
    if local is None:
        w = lines.repartition(file_col).sortWithinPartitions(file_col, order_col)
    else:
        size = lines.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()[0]
        w = lines.repartitionByRange(part_count(spark, size), file_col, order_col).sortWithinPartitions(file_col, order_col)
    w = w.select(file_col, "value").write.mode("overwrite").partitionBy(file_col)
    if codec:
        w = w.option("compression", codec)
    if local is None:
        w.text(path)
        _rename_parts(spark, path, old, new)
        return path
    parts = scratch_path(spark, "lines")
    w.text(parts)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = place(parts).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(place(path), True)  # overwritten, as Spark's writer does
    found = fs.listStatus(place(parts))
    folders = [(x.getPath().getName(),) for x in found if x.isDirectory()]  # names only, one for each file
    if folders:
        tasks = spark.sparkContext.parallelize(folders, len(folders))
        tasks.foreachPartition(lambda rows, a=_local(parts), b=local: _copy_parts(rows, a, b, fmt))
    return path
