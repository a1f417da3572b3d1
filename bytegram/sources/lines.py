"""Lines of JSON-lines files: their numbers, and their records with every field as it was written.

A task reads the lines of a split in order, so it numbers and parses them in one pass (Arrow batches in, Arrow batches
out). Only files that Spark may cut into several splits need the line counts of the splits before: a first pass counts
those files' lines, a row for each split, and a split's rows meet its base by a key that no more than one split's rows
share. Compressed and small files are never cut; their lines are read once and joined with nothing.

Records follow the rules of JSON as Python's ``json`` reads it: of a repeated key the last value counts, integers keep
all digits, ``1.0`` stays a decimal, ``1e400`` and ``NaN`` are allowed. Spark's own JSON types change such values, which is
why the parser is Python here.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines that a task holds as Python's objects, which are several times larger than the lines.
_PARSED = 500
_LINES = pa.schema([("_abs", pa.string()), ("_blk", pa.int64()), ("_k", pa.int64()), ("value", pa.string())])
_RECORDS = pa.schema([("_abs", pa.string()), ("_blk", pa.int64()), ("_k", pa.int64()), ("text", pa.string()), ("fields", pa.string())])


def file_path_col() -> F.Column:
    """``_metadata.file_path`` is URI-encoded; decode it (keeping a literal ``+``) to match listings."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def located(lines: DataFrame) -> DataFrame:
    """``_abs, _blk, value``: each line of a text scan with its file and the first byte of its split."""
    if "_abs" in lines.columns:  # already located, as in a stream's batch
        return lines.select("_abs", "_blk", "value")
    return lines.select(file_path_col().alias("_abs"), F.col("_metadata.file_block_start").alias("_blk"), "value")


def _ordinals(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Each batch with the numbers of its lines inside their split."""
    split, n = None, 0
    for batch in batches:
        numbers = []
        for name, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if (name, block) != split:
                split, n = (name, block), 0
            numbers.append(n)
            n += 1
        yield batch, numbers


def _count_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, numbers in _ordinals(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers, pa.int64()), batch.column(2)], schema=_LINES)


def _dumped(value) -> str:
    out = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    try:
        out.encode()
    except UnicodeEncodeError:  # half of a surrogate pair
        out = json.dumps(value, separators=(",", ":"))
    return out


def parse(line: str, text_key: str, meta_key: str | None = None) -> tuple[str | None, str | None]:
    """Text and all other fields (or, with ``meta_key``, that field alone) of a JSON object; nulls if there is no text."""
    try:
        record = json.loads(line)
        text = record.pop(text_key)
        text.encode()
    except (ValueError, TypeError, AttributeError, KeyError, RecursionError):
        return None, None
    return text, _dumped(record.get(meta_key, {}) if meta_key is not None else record)


def numbered(lines: DataFrame, cut: bool) -> DataFrame:
    """``_abs, linenum, value``. ``cut``: files may be read in several splits."""
    rows = located(lines).mapInArrow(_count_on, "_abs string, _blk long, _k long, value string")
    return _absolute(rows, lines, cut, ["value"])


def records(lines: DataFrame, cut: bool, text_key: str, meta_key: str | None = None) -> DataFrame:
    """``_abs, linenum, text, fields``; the text of a line that holds no such record is null."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, numbers in _ordinals(batches):
            for at in range(0, len(numbers), _PARSED):
                batch = whole.slice(at, _PARSED)
                found = [parse(x, text_key, meta_key) for x in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(numbers[at:at + _PARSED], pa.int64()),
                     pa.array([t for t, _ in found], pa.string()), pa.array([f for _, f in found], pa.string())], schema=_RECORDS)

    rows = located(lines).mapInArrow(read, "_abs string, _blk long, _k long, text string, fields string")
    return _absolute(rows, lines, cut, ["text", "fields"])


def _absolute(rows: DataFrame, lines: DataFrame, cut: bool, columns: list[str]) -> DataFrame:
    if not cut:
        return rows.select("_abs", F.col("_k").alias("linenum"), *columns)
    splits = located(lines).groupBy("_abs", "_blk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_abs").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("_abs", "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")).filter("_base > 0")
    # A row for each split, which the driver lists anyway: records are not shuffled for it.
    return (rows.join(F.broadcast(bases), ["_abs", "_blk"], "left")
            .select("_abs", (F.coalesce("_base", F.lit(0)) + F.col("_k")).alias("linenum"), *columns))


def may_be_cut(spark: SparkSession, path: str, length: int) -> bool:
    """Can Spark read this file in several splits? Not a compressed one, nor one that is smaller than the least split."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    least = min(size(spark.conf.get(f"spark.sql.files.{key}")) for key in ("maxPartitionBytes", "openCostInBytes"))
    return path.endswith(".jsonl") and length > least
