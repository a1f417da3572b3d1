"""``find``: the suffix-rank interval ``[lo, hi)`` of a query in every shard, by scanning.

In a shard's virtual byte string every suffix starting at a text byte runs to its document's end and
then hits a terminator: the next separator (0xFF, greater than any UTF-8 byte) or, for the last
document, the sentinel (0x00, smaller). A UTF-8 query never contains either, so comparing the first
n bytes of ``text || terminator`` from a position with the query decides the order of the whole suffix.
Separator suffixes are greater than any non-empty query; the sentinel suffix is smaller.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.bytes import lit_bytes, utf8
from .positions import chunks


def terminated_bytes(layout: DataFrame) -> F.Column:
    """``text || terminator`` as BINARY: the stored ``bytes`` column of a corpus table when present."""
    if "bytes" in layout.columns:
        return F.col("bytes")
    last = (F.col("data_offset") + F.col("doc_len") + 2) == F.col("shard_bytes")
    return F.concat(utf8("text"), F.when(last, lit_bytes(b"\x00")).otherwise(lit_bytes(b"\xff")))


def find_scan(layout: DataFrame, q: str) -> DataFrame:
    """``query, shard, lo, hi`` for every shard."""
    return find_scan_many(layout, [q])


def find_scan_many(layout: DataFrame, queries: list[str]) -> DataFrame:
    """``query, shard, lo, hi`` for a short literal list of queries, which may hold the empty one.

    Positions are exploded once whatever the number of queries: each position's head is compared with every query, and
    the sums are partial per task. Long documents are cut into chunks. A document without text still names its shard.
    """
    qs = [q for q in dict.fromkeys(queries) if q != ""]
    maxn = max((len(q.encode("utf-8")) for q in qs), default=0)
    if qs:
        # A head of maxn bytes from the last owned position needs as many bytes beyond it, the terminator included.
        pieces = chunks(layout, overlap=maxn, keep=("shard", "shard_bytes"), bytes_col=terminated_bytes(layout),
                        own_col=F.col("doc_len"))
        at = F.when(F.col("own") > 0, F.sequence(F.lit(1), F.col("own")))
        pos = (pieces.select("shard", "shard_bytes", "cb", F.explode_outer(at).alias("_p"))
               .select("shard", "shard_bytes", F.substring("cb", F.col("_p"), F.lit(maxn)).alias("_k")))
    else:
        pos = layout.select("shard", "shard_bytes")
    sums, rows = [F.max("shard_bytes").cast("bigint").alias("_size")], []
    for j, q in enumerate(qs):
        qb = q.encode("utf-8")
        head = F.substring("_k", F.lit(1), F.lit(len(qb)))
        sums += [F.sum(F.when(head < lit_bytes(qb), 1).otherwise(0)).alias(f"_lt{j}"),
                 F.sum(F.when(head == lit_bytes(qb), 1).otherwise(0)).alias(f"_eq{j}")]
        # +1: the sentinel suffix sorts below every non-empty query.
        lo = F.col(f"_lt{j}") + 1
        rows.append(F.struct(F.lit(q).alias("query"), lo.cast("bigint").alias("lo"),
                             (lo + F.col(f"_eq{j}")).cast("bigint").alias("hi")))
    if "" in queries:
        rows.append(F.struct(F.lit("").alias("query"), F.lit(0).cast("bigint").alias("lo"), F.col("_size").alias("hi")))
    return (pos.groupBy("shard").agg(*sums).select("shard", F.explode(F.array(*rows)).alias("_r"))
            .select("_r.query", F.col("shard").cast("bigint").alias("shard"), "_r.lo", "_r.hi"))


def find_total(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("query").agg(F.sum(F.col("hi") - F.col("lo")).cast("bigint").alias("cnt"))
