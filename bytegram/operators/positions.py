"""Per-position relations over document bytes.

Documents are cut into chunks of at most ``chunk_bytes`` owned positions plus an ``overlap`` of bytes
that belong to the next chunk, so a pattern of up to ``overlap + 1`` bytes that starts in a chunk lies
wholly inside it. Chunks of long documents are spread over tasks so one huge document does not become
one huge task; short documents stay where they were read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import CHUNK_BYTES
from ..functions.bytes import utf8


def chunks(docs: DataFrame, overlap: int, chunk_bytes: int = CHUNK_BYTES, keep: tuple[str, ...] = (),
           bytes_col: F.Column | None = None, own_col: F.Column | None = None) -> DataFrame:
    """``doc_ix, c, cstart, own, cb`` (+ ``keep``): chunk ``c`` owns 1-based positions ``1..own`` of ``cb``,
    i.e. document bytes ``cstart+1 .. cstart+own``; ``cb`` extends ``overlap`` bytes further."""
    spark, overlap = docs.sparkSession, max(0, int(overlap))
    stored = "bytes" in docs.columns and "doc_len" in docs.columns
    if bytes_col is None:
        # The stored column of a corpus table (text + terminator); its last byte is not a position.
        bytes_col = F.col("bytes") if stored else utf8("text")
        if own_col is None and stored:
            own_col = F.col("doc_len")
    b = docs.select("doc_ix", *keep, bytes_col.alias("_b"),
                    (own_col if own_col is not None else F.lit(None)).alias("_own"))
    # Owned positions: all bytes, unless the caller owns fewer (e.g. not a trailing terminator).
    b = b.withColumn("_len", F.coalesce(F.col("_own"), F.octet_length("_b")).cast("int")).drop("_own")
    small = (b.filter(F.col("_len") <= chunk_bytes)
             .select("doc_ix", *keep, F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("cstart"),
                     F.col("_len").alias("own"), F.col("_b").alias("cb")))
    nch = F.ceil(F.col("_len") / F.lit(chunk_bytes)).cast("int")
    arr = F.transform(F.sequence(F.lit(0), nch - 1),
                      lambda c: F.substring(F.col("_b"), c * chunk_bytes + 1, chunk_bytes + overlap))
    big = (b.filter(F.col("_len") > chunk_bytes)
           .select("doc_ix", *keep, "_len", F.posexplode(arr).alias("c", "cb"))
           .select("doc_ix", *keep, "c", (F.col("c").cast("bigint") * chunk_bytes).alias("cstart"),
                   F.least(F.lit(chunk_bytes), F.col("_len") - F.col("c") * chunk_bytes).cast("int").alias("own"),
                   "cb")
           # a number, as else few bytes that pack well become one task, whose every position costs
           .repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "doc_ix", "c"))
    return small.unionByName(big)


def grams(ch: DataFrame, s: int, extra: int = 0) -> DataFrame:
    """``doc_ix, c, cstart, own, p, gram``: the ``s`` bytes at 1-based chunk position ``p`` for
    ``p <= own + extra`` (and while ``s`` bytes remain)."""
    last = F.least(F.octet_length("cb") - s + 1, F.col("own") + extra)
    return (ch.filter(last >= 1)
            .select("doc_ix", "c", "cstart", "own", "cb", F.explode(F.sequence(F.lit(1), last)).alias("p"))
            .select("doc_ix", "c", "cstart", "own", "p", F.substring("cb", F.col("p"), F.lit(s)).alias("gram")))


def grams_multi(ch: DataFrame, lengths: list[int], extra: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_ix, c, own, p, s, gram`` (+ ``keep``) for every gram length ``s`` in ``lengths`` in ONE pass over the
    positions (one explode of positions, then one row per length, filtered to full-length grams)."""
    lengths = sorted(set(lengths))
    smin = lengths[0]
    last = F.least(F.octet_length("cb") - smin + 1, F.col("own") + extra)
    pos = (ch.filter(last >= 1)
           .select("doc_ix", "c", "own", "cb", *[k for k in keep if k != "cb"], F.explode(F.sequence(F.lit(1), last)).alias("p")))
    if len(lengths) == 1:
        return pos.select("doc_ix", "c", "own", "p", *keep, F.lit(smin).alias("s"),
                          F.substring("cb", F.col("p"), F.lit(smin)).alias("gram"))
    per = F.array(*[F.struct(F.lit(s).alias("s"), F.substring("cb", F.col("p"), F.lit(s)).alias("gram"))
                    for s in lengths])
    return (pos.select("doc_ix", "c", "own", "p", *keep, F.explode(per).alias("_g"))
            .select("doc_ix", "c", "own", "p", *keep, F.col("_g.s").alias("s"), F.col("_g.gram").alias("gram"))
            .filter(F.octet_length("gram") == F.col("s")))
