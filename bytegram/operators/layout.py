"""Corpus layout: global document order, byte offsets, shards.

The corpus of a shard is the virtual byte string ``FF text_0 FF text_1 … FF text_m 00``. Nothing is
concatenated: each document row carries the offset of its separator inside its shard (``data_offset``)
and of its metadata line (``meta_offset``). Offsets are prefix sums computed in two levels so no window
ever runs over more than one bucket of rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import PREFIX_BUCKET_ROWS
from ..functions.bytes import byte_len, lit_bytes, utf8
from ..session import checkpoint_root, part_count


def exclusive_prefix_sums(df: DataFrame, order_col: str, weights: dict[str, Column],
                          bucket_rows: int = PREFIX_BUCKET_ROWS) -> DataFrame:
    """Add, for each ``name -> weight``, the sum of ``weight`` over all rows ordered before this one
    (``name``) and the grand total (``name_total``).

    ``order_col`` must be a dense, unique BIGINT (a document index). Level 1 sums buckets of
    ``bucket_rows`` rows (one small row per bucket, so the bucket-level running sum runs in one task over
    #rows/bucket_rows rows); level 2 is a window partitioned by bucket, bounded by ``bucket_rows``.
    """
    x = df.withColumn("_bkt", F.floor(F.col(order_col) / F.lit(bucket_rows)).cast("bigint"))
    for name, w in weights.items():
        x = x.withColumn(f"_w_{name}", w.cast("bigint"))
    bsum = x.groupBy("_bkt").agg(*[F.sum(f"_w_{n}").alias(f"_bs_{n}") for n in weights])
    before = Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bbase = bsum.select(
        "_bkt",
        *[F.coalesce(F.sum(f"_bs_{n}").over(before), F.lit(0)).alias(f"_bb_{n}") for n in weights],
        *[F.sum(f"_bs_{n}").over(whole).alias(f"{n}_total") for n in weights],
    )
    inb = Window.partitionBy("_bkt").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    for name in weights:
        x = x.withColumn(f"_in_{name}", F.coalesce(F.sum(f"_w_{name}").over(inb), F.lit(0)))
    x = x.join(bbase, "_bkt")
    for name in weights:
        x = x.withColumn(name, (F.col(f"_bb_{name}") + F.col(f"_in_{name}")).cast("bigint"))
    drop = ["_bkt"] + [c for n in weights for c in (f"_w_{n}", f"_in_{n}", f"_bb_{n}")]
    return x.drop(*drop)


def global_doc_index(records: DataFrame) -> DataFrame:
    """``doc_ix`` = records in earlier files (files ordered by path) + record number in the file.

    Needs only a per-file count (one row per file) and its running sum; no global sort of records.
    """
    per_file = records.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_file.select("path", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("bigint").alias("_file_base"))
    # A row for each file, whose names the driver lists anyway: texts are not shuffled for it.
    return (records.join(F.broadcast(bases), "path")
            .withColumn("doc_ix", (F.col("_file_base") + F.col("linenum")).cast("bigint"))
            .drop("_file_base"))


def assign_shards(docs: DataFrame, num_shards: int) -> DataFrame:
    """Byte-balanced contiguous shards and per-shard offsets.

    Input: ``doc_ix, text, metadata`` (dense ``doc_ix``). Output adds ``doc_len, shard, data_offset,
    meta_offset, shard_bytes, shard_docs, shard_first_doc``. The target is total/N bytes per shard;
    a shard id that receives no document is skipped and ids are renumbered densely.

    Only ``doc_ix`` and the two lengths go through the windows (checkpointed, so texts are not read again for
    them); texts are shuffled once, to meet their offsets and to lie in order of ``doc_ix`` (:func:`placed`).
    """
    if num_shards < 1:
        raise ValueError("num_shards must be >= 1")
    checkpoint_root(docs.sparkSession)
    x = docs.select("doc_ix", byte_len("text").alias("doc_len"), byte_len("metadata").alias("_mlen")).checkpoint()
    count, size = x.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("doc_len") + F.col("_mlen")), F.lit(0))).first()
    x = exclusive_prefix_sums(x, "doc_ix", {"_g": F.col("doc_len") + 1, "_gm": F.col("_mlen") + 1})
    x = x.withColumn("_shard0", F.least(F.lit(num_shards - 1),
                                         F.expr(f"(_g * {num_shards}) div greatest(_g_total, 1)")).cast("int"))
    stats = x.groupBy("_shard0").agg(
        F.min("_g").alias("_g0"), F.min("_gm").alias("_gm0"),
        F.sum(F.col("doc_len") + 1).alias("_body"), F.count(F.lit(1)).alias("shard_docs"),
        F.min("doc_ix").alias("shard_first_doc"))
    stats = stats.withColumn("shard", (F.dense_rank().over(Window.orderBy("_shard0")) - 1).cast("int"))
    stats = stats.withColumn("shard_bytes", (F.col("_body") + 1).cast("bigint")).drop("_body")
    # At most num_shards rows: the broadcast is bounded by a parameter.
    x = x.join(F.broadcast(stats), "_shard0")
    x = (x.withColumn("data_offset", (F.col("_g") - F.col("_g0")).cast("bigint"))
         .withColumn("meta_offset", (F.col("_gm") - F.col("_gm0")).cast("bigint"))
         .drop("_shard0", "_g", "_gm", "_g0", "_gm0", "_g_total", "_gm_total", "_mlen"))
    return with_bytes(placed(docs, x, count, size))


def placed(docs: DataFrame, places: DataFrame, count: int, size: int) -> DataFrame:
    """``docs`` with the columns of ``places``, by ``doc_ix``, in parts that hold runs of ``doc_ix`` in order.

    Both sides are one sequence, shuffled once: a document comes behind its place. ``count`` documents of ``size`` bytes: parts
    become more as documents do, so that a part's sort stays in memory.
    """
    n = part_count(docs.sparkSession, size)
    columns = [c for c in places.columns if c != "doc_ix"]
    both = docs.withColumn("_tag", F.lit(1)).unionByName(
        places.select("doc_ix", F.struct(*columns).alias("_at"), F.lit(0).alias("_tag")), allowMissingColumns=True)
    both = both.withColumn("_part", F.expr(f"least({n - 1}, (doc_ix * {n}) div {max(count, 1)})").cast("int")).repartitionById(n, "_part")
    w = Window.partitionBy("_part", "doc_ix").orderBy("_tag").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_at", F.last("_at", ignorenulls=True).over(w)).filter("_tag = 1")
    return both.select(*docs.columns, *[F.col(f"_at.{c}").alias(c) for c in columns])


def with_bytes(layout: DataFrame) -> DataFrame:
    """Add ``bytes``: the document's UTF-8 bytes followed by its terminator (the next separator 0xFF, or the
    shard's sentinel 0x00 for its last document).

    Kept as a stored column on purpose: per-position operators explode positions and cut ``bytes``; if the
    bytes were an expression, the optimizer would move it above the explode and re-encode the whole
    document for every position."""
    last = (F.col("data_offset") + F.col("doc_len") + 2) == F.col("shard_bytes")
    return layout.withColumn("bytes", F.concat(utf8("text"), F.when(last, lit_bytes(b"\x00"))
                                               .otherwise(lit_bytes(b"\xff"))))


def shard_sizes(layout: DataFrame) -> DataFrame:
    """One row per shard: documents and corpus bytes (with separators and sentinel)."""
    return (layout.groupBy("shard").agg(F.count(F.lit(1)).alias("doc_cnt"),
                                       F.sum(F.col("doc_len") + 1).alias("body"))
            .select(F.col("shard").cast("bigint").alias("shard"), F.col("doc_cnt").cast("bigint").alias("doc_cnt"),
                    (F.col("body") + 1).cast("bigint").alias("shard_bytes")))


def doc_bounds(layout: DataFrame) -> DataFrame:
    """Document bounds inside its shard: ``doc_start = data_offset + 1``, ``doc_end = doc_start + doc_len``."""
    return layout.select(
        "shard", "doc_ix", "data_offset",
        (F.col("data_offset") + 1).alias("doc_start"),
        (F.col("data_offset") + 1 + F.col("doc_len")).alias("doc_end"),
        "doc_len")


def corpus_bytes(layout: DataFrame) -> DataFrame:
    """Total corpus size over all shards = sum(doc_len + 1) + one sentinel per shard."""
    per = shard_sizes(layout)
    return per.agg(F.sum("shard_bytes").cast("bigint").alias("corpus_bytes"),
                   F.count(F.lit(1)).cast("bigint").alias("num_shards"))


def explicit_shards(docs: DataFrame) -> DataFrame:
    """Layout for documents that already carry a ``shard`` column (contiguous runs of ``doc_ix``)."""
    x = docs.withColumn("doc_len", byte_len("text")).withColumn("_mlen", byte_len("metadata"))
    x = exclusive_prefix_sums(x, "doc_ix", {"_g": F.col("doc_len") + 1, "_gm": F.col("_mlen") + 1})
    stats = x.groupBy("shard").agg(
        F.min("_g").alias("_g0"), F.min("_gm").alias("_gm0"),
        (F.sum(F.col("doc_len") + 1) + 1).cast("bigint").alias("shard_bytes"),
        F.count(F.lit(1)).alias("shard_docs"), F.min("doc_ix").alias("shard_first_doc"))
    x = x.join(F.broadcast(stats), "shard")
    x = (x.withColumn("data_offset", (F.col("_g") - F.col("_g0")).cast("bigint"))
         .withColumn("meta_offset", (F.col("_gm") - F.col("_gm0")).cast("bigint"))
         .withColumn("shard", F.col("shard").cast("int"))
         .drop("_g", "_gm", "_g0", "_gm0", "_g_total", "_gm_total", "_mlen"))
    return with_bytes(x)


def corpus_offsets(records: DataFrame, corpus: str) -> DataFrame:
    """``records`` (``path, linenum, text, fields`` and a ``corpus`` column whose values are runs of paths) as one corpus for
    each value: ``corpus, k, data_offset, metadata`` of each document in order, and a last row with the total.

    Sums run over all records once, in two levels; a corpus is a segment whose first sum is taken off.
    """
    order = Window.partitionBy(corpus).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    x = global_doc_index(records)
    files = x.groupBy(corpus, "path").agg(F.count(F.lit(1)).alias("_n"))
    files = files.select("path", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    lengths = exclusive_prefix_sums(x.select("doc_ix", corpus, "path", "linenum", byte_len("text").alias("_len"),
                                             F.col("fields").alias("metadata")), "doc_ix", {"_g": F.col("_len") + 1})
    base = lengths.groupBy(corpus).agg(F.min("_g").alias("_g0"), F.count(F.lit(1)).alias("k"), F.sum(F.col("_len") + 1).alias("_total"))
    rows = lengths.join(base.select(corpus, "_g0"), corpus).join(files, "path").select(
        F.col(corpus).alias("corpus"), (F.col("_before") + F.col("linenum")).alias("k"), (F.col("_g") - F.col("_g0")).alias("data_offset"), "metadata")
    ends = base.select(F.col(corpus).alias("corpus"), "k", F.col("_total").alias("data_offset"), F.lit(None).cast("string").alias("metadata"))
    return rows.unionByName(ends)
