"""Benchmark decontamination by size-partitioned MinHash containment search, with DataFrame functions only.

A benchmark item is found in a document if the document holds at least ``containment`` of the item's distinct word
shingles. Items are partitioned by their number of shingles. A partition fixes the length of its items' MinHash
sketches: so many of an item's smallest shingle hashes that at least one must occur in every document that contains
the item (if ``n - k`` of ``n`` shingles may be missing, any ``n - k + 1`` hold one that is not). Documents of any length
are searched by these hashes, so no document is too long for a short item, and none is missed. Candidate pairs are
verified by exact shingles, as text.

Words are runs of letters and digits, lower-cased. An item of fewer words than a shingle is one shingle of all its
words; an item without words is never found. Null and empty documents match nothing. Repeated rows share their result.
An item is known by its id and a hash of its text: different items under one id, or under none, are each searched for.
Where several of one id occur in a document, each makes a row. Rows of the benchmark that repeat are one item.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytegram.llm.common import written

#: Sketches and shingle tables of up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text.cast("string")), "[^\\p{L}\\p{N}]+"), "")


def _shingles(tokens: Column, k: int, hashed: bool) -> Column:
    """Distinct runs of ``k`` words, as text or as a hash; none if there are fewer words."""
    def one(word: Column, i: Column) -> Column:
        run = [word, *[F.get(tokens, i + j) for j in range(1, k)]]
        return F.xxhash64(F.lit(k), *run) if hashed else F.concat_ws(" ", *run)

    starts = F.slice(tokens, 1, F.greatest(F.size(tokens) - (k - 1), F.lit(0)))
    return F.array_distinct(F.transform(starts, one))


def _with_length(shingles: Column, k: int) -> Column:
    return F.transform(shingles, lambda s: F.struct(F.lit(k).alias("k"), s.alias("shingle")))


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, containment: float = 0.8) -> DataFrame:
    """``doc_id, text_hash, item_id, n_shared, n_shingles`` of each document and each item that it contains."""
    items = benchmark.select("item_id", F.xxhash64(F.col("item_id").cast("string"), F.col("item_id").isNull(),
                                                   F.col("text").cast("string")).alias("item"),
                             words(F.col("text")).alias("words")).filter("size(words) > 0")
    names = items.select("item", "item_id").distinct()
    items = items.withColumn("k", F.least(F.size("words"), F.lit(shingle)))
    pieces = None
    for k in range(1, shingle + 1):
        some = items.filter(F.col("k") == k)
        some = some.select("item", "k", F.explode(F.arrays_zip(
            _shingles(F.col("words"), k, False).alias("shingle"), _shingles(F.col("words"), k, True).alias("h"))).alias("x"))
        some = some.select("item", "k", F.col("x.shingle").alias("shingle"), F.col("x.h").alias("h"))
        pieces = some if pieces is None else pieces.unionByName(some)
    pieces = written(pieces.distinct(), "benchmark")
    ks = sorted(r["k"] for r in pieces.select("k").distinct().collect())  # at most ``shingle`` values
    sizes = pieces.groupBy("item").agg(F.count("*").alias("n"))
    most = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1  # upper end of the size partition
    sizes = sizes.withColumn("sketch", F.floor(most * (1 - containment) + 1e-9) + 1)
    sketches = pieces.join(sizes, "item")
    ordered = sketches.groupBy("item").agg(F.sort_array(F.collect_list("h")).alias("h"), F.max("sketch").alias("sketch"))
    sketches = written(ordered.select("item", F.explode(F.slice("h", 1, F.col("sketch").cast("int"))).alias("h")), "sketches")
    top = sketches.agg(F.max("h")).first()[0]
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
                       F.xxhash64("text").alias("text_hash"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = docs.filter("text IS NOT NULL").select("id", "text_hash", words(F.col("text")).alias("words"))
    if top is None:
        ks, top = [shingle], 0
    hashed = [F.filter(_shingles(F.col("words"), k, True), lambda h: h <= F.lit(top)) for k in ks]
    found = tokens.select("id", "text_hash", F.explode(F.concat(*hashed)).alias("h"))
    found = written(found.join(_bounded(sketches), "h").select("id", "text_hash", "item").distinct(), "leaks")
    some = docs.join(found.select("id", "text_hash").distinct(), ["id", "text_hash"], "left_semi")
    some = some.select("id", "text_hash", "doc_id", words(F.col("text")).alias("words"))
    texts = [_with_length(_shingles(F.col("words"), k, False), k) for k in ks]
    exact = some.select("id", "text_hash", "doc_id", F.explode(F.concat(*texts)).alias("s")).select(
        "id", "text_hash", "doc_id", "s.k", "s.shingle")
    exact = exact.join(_bounded(pieces.select("item", "k", "shingle")), ["k", "shingle"])
    exact = exact.groupBy("id", "text_hash", "doc_id", "item").agg(F.countDistinct("k", "shingle").alias("n_shared"))
    exact = exact.join(found, ["id", "text_hash", "item"], "left_semi").join(_bounded(sizes.join(names, "item")), "item")
    return (exact.filter(F.col("n_shared") >= F.col("n") * containment - 1e-9)
            .select("doc_id", "text_hash", "item_id", "n_shared", F.col("n").alias("n_shingles")))
