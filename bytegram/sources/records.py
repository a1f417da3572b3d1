"""Record sources: file listing, Parquet and JSON-lines (plain, gzip, zstd) readers.

Every reader returns the same record schema::

    path STRING (relative to the common source root), linenum BIGINT (0-based, absolute in the file),
    text STRING, fields STRING (JSON object of every other field, nulls kept)

Corpus order is (path, linenum). Nothing is read on the driver except the file listing Spark makes
anyway and two scalars (min and max path) for the common root.
"""
from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..constants import SOURCE_SUFFIXES
from .discovery import list_sources, qualify  # noqa: F401
from .footers import column_groups, footers
from .lines import file_path_col, may_be_cut, numbered, records

_JSONL = (".jsonl", ".json.gz", ".zst", ".zstd")


def common_root(listing: DataFrame) -> str:
    """Deepest directory containing every listed file.

    The common prefix of a set of strings equals the common prefix of its least and greatest member,
    so two scalars suffice; the prefix is then cut back to a path segment.
    """
    row = listing.agg(F.min("path").alias("lo"), F.max("path").alias("hi")).first()
    if row is None or row["lo"] is None:
        raise FileNotFoundError("no supported source files")
    return common_folder(row["lo"], row["hi"])


def common_folder(lo: str, hi: str) -> str:
    """The deepest folder that holds both of two paths, with a slash behind it."""
    n = 0
    while n < min(len(lo), len(hi)) and lo[n] == hi[n]:
        n += 1
    return lo[:lo.rfind("/", 0, n) + 1]


def relative_path(abs_col: F.Column, root: str) -> F.Column:
    root = root if root.endswith("/") else root + "/"
    return F.when(abs_col.startswith(root), F.substring(abs_col, len(root) + 1, 1 << 30)).otherwise(abs_col)


def parquet_records(spark: SparkSession, files: list[str], root: str, text_key: str = "text",
                    on_bad: str = "fail", listing: DataFrame | None = None, one_table: bool = False) -> DataFrame:
    """Parquet rows as records. ``linenum`` is the row index inside the file.

    Files may differ in their columns, also in the types of columns of one name: files with the same columns are one
    scan, and a record has the fields of its own file only. ``listing`` saves listing ``files`` (or folders) again.
    ``one_table``: ``files`` are one table, whose columns all records have (null where a file lacks one); no footer is looked at.
    """
    groups = [files] if one_table else column_groups(spark, listing if listing is not None else list_sources(spark, files))
    out = None
    for group in groups:
        df = spark.read.option("mergeSchema", one_table).parquet(*group)
        if text_key not in df.columns:
            raise KeyError(f"text field {text_key!r} not in {df.columns}")
        others = [F.col(f"`{c}`") for c in df.columns if c != text_key]
        rec = df.select(
            relative_path(file_path_col(), root).alias("path"),
            F.col("_metadata.row_index").cast("bigint").alias("linenum"),
            F.col(text_key).cast("string").alias("text"),
            (F.to_json(F.struct(*others), {"ignoreNullFields": "false"}) if others else F.lit("{}")).alias("fields"))
        out = rec if out is None else out.unionByName(rec)
    if out is None:
        raise FileNotFoundError("no Parquet source files")
    return _bad_rows(out, on_bad)


def text_line_numbers(lines: DataFrame) -> DataFrame:
    """``_abs, linenum, value`` of a text scan: 0-based line numbers, absolute in each file however it is cut."""
    return numbered(lines, cut=True)


def parse_jsonl_lines(lines: DataFrame, root: str, text_key: str = "text", on_bad: str = "fail",
                      meta_key: str | None = None, cut: bool = True) -> DataFrame:
    """A text scan's lines → records: text out, every other field kept as JSON, or only the object under ``meta_key``."""
    rec = records(lines, cut, text_key, meta_key).select(relative_path(F.col("_abs"), root).alias("path"), "linenum", "text", "fields")
    return _bad_rows(rec, on_bad)


def jsonl_records(spark: SparkSession, files: list[tuple[str, int]], root: str, text_key: str = "text",
                  on_bad: str = "fail", meta_key: str | None = None) -> DataFrame:
    """JSON-lines records (``.jsonl``, ``.json.gz``, ``.zst``, ``.zstd``; codec chosen by Spark from the
    file ending) of ``(path, length)``. The line reader ends records at ``\n``, ``\r\n`` or a lone ``\r``."""
    out = None
    for cut in (False, True):
        some = [p for p, n in files if may_be_cut(spark, p, n) == cut]
        if some:
            rec = parse_jsonl_lines(spark.read.text(some), root, text_key, on_bad, meta_key, cut)
            out = rec if out is None else out.unionByName(rec)
    return out


def _bad_rows(rec: DataFrame, on_bad: str) -> DataFrame:
    """A record without text fails the whole job (default) or is dropped (``on_bad='drop'``)."""
    if on_bad == "drop":
        return rec.filter(F.col("text").isNotNull())
    if on_bad != "fail":
        raise ValueError("on_bad must be 'fail' or 'drop'")
    return rec.withColumn("text", F.when(F.col("text").isNull(), F.raise_error(
        F.concat(F.lit("record without text: "), F.col("path"), F.lit(":"), F.col("linenum").cast("string"))))
        .otherwise(F.col("text")))


def read_listing(spark: SparkSession, listing: DataFrame, root: str, text_key: str = "text", on_bad: str = "fail",
                 meta_key: str | None = None) -> DataFrame:
    """The files of ``listing (path, length)`` as one record table (Parquet and JSON-lines unioned)."""
    # Names and lengths: Spark's readers take a list of files, and their file index holds it on the driver anyway.
    files = [(r["path"], r["length"]) for r in listing.select("path", "length").collect()]
    hidden = [p for p, _ in files if posixpath.basename(p)[0] in "_."]
    if hidden:
        raise ValueError(f"Spark's readers skip file names that begin with '_' or '.': rename {hidden[:3]}")
    parts = []
    if any(p.endswith(".parquet") for p, _ in files):
        parts.append(parquet_records(spark, [], root, text_key, on_bad, listing=listing))
    js = [f for f in files if f[0].endswith(_JSONL)]
    if js:
        parts.append(jsonl_records(spark, js, root, text_key, on_bad, meta_key))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_records(spark: SparkSession, paths: list[str] | str, text_key: str = "text",
                 on_bad: str = "fail", meta_key: str | None = None) -> DataFrame:
    """All accepted files under ``paths`` as one record table."""
    listing = list_sources(spark, paths)
    return read_listing(spark, listing, common_root(listing), text_key, on_bad, meta_key)


def metadata_envelope(records: DataFrame) -> F.Column:
    """``{"path": …, "linenum": …, "metadata": {…}}`` as one JSON string per record (nulls kept)."""
    head = F.to_json(F.struct(F.col("path"), F.col("linenum")))
    return F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"metadata":'), F.col("fields"), F.lit("}"))


def records_per_file(records: DataFrame) -> DataFrame:
    return records.groupBy("path").agg(F.count(F.lit(1)).cast("bigint").alias("records"))


def source_counts(spark: SparkSession, listing: DataFrame) -> DataFrame:
    """``path, records`` of each listed file, without reading a record: Parquet files say it in their footers, of
    JSON-lines files the lines are counted and not parsed."""
    out = footers(spark, listing).select("path", "records")
    js = [r["path"] for r in listing.collect() if r["path"].endswith(_JSONL)]
    if js:
        counted = spark.read.text(js).groupBy(file_path_col().alias("path")).agg(F.count(F.lit(1)).alias("records"))
        empty = listing.filter(F.col("path").isin(js)).join(counted, "path", "left")
        out = out.unionByName(empty.select("path", F.coalesce("records", F.lit(0)).cast("bigint").alias("records")))
    return out


def numbered_by_folder(records: DataFrame, counts: DataFrame, root: str) -> DataFrame:
    """``records`` whose ``linenum`` runs on over the files of a folder, in order of their paths. ``counts``: :func:`source_counts`."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    before = Window.partitionBy(folder).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(relative_path(F.col("path"), root).alias("path"), F.coalesce(F.sum("records").over(before), F.lit(0)).alias("_base"))
    # a row for each file, whose names the driver lists anyway
    return records.join(F.broadcast(bases), "path").withColumn("linenum", F.col("_base") + F.col("linenum")).drop("_base")


def record_slice(records: DataFrame, path: str, start: int, end: int = -1) -> DataFrame:
    """Half-open record range ``[start, end)`` of one file; ``end = -1`` means to the end."""
    cond = (F.col("path") == F.lit(path)) & (F.col("linenum") >= F.lit(start))
    if end != -1:
        cond = cond & (F.col("linenum") < F.lit(end))
    return records.filter(cond)


def read_slice(spark: SparkSession, listing: DataFrame, root: str, path: str, start: int, end: int = -1,
               text_key: str = "text", on_bad: str = "fail") -> DataFrame:
    """:func:`record_slice` that reads no other file of the listing."""
    mine = listing.filter(relative_path(F.col("path"), root) == F.lit(path))
    return record_slice(read_listing(spark, mine, root, text_key, on_bad), path, start, end)


def pending_sources(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Resume: listed files not yet recorded (same path and size) in the manifest of finished work."""
    return listing.join(manifest.select("path", "length"), ["path", "length"], "left_anti")


def basename_stem(path: str) -> str:
    base = posixpath.basename(path)
    for s in SOURCE_SUFFIXES:
        if base.endswith(s):
            return base[: -len(s)]
    return base
