"""Mixing sources to target weights by repeating documents.

Tokens are summed up by source; the sources' targets follow from their weights, and target over size is the rate at which
a source's documents repeat. A document is emitted floor(rate) times, and once more by a draw that comes out with
probability equal to the fraction. The draws of a source use one hash-seeded uniform number and go through its documents
in order of size and of a seeded hash of the id: the document at place k is drawn where ``floor(k * fraction + u)`` steps up.
Each draw alone is a Bernoulli draw with the fraction as probability, but draws of documents of like size balance each
other, so that a source ends within about one long document of its target also where it has few documents, very long ones or a
hot repeated row (equal rows have places, and so draws, of their own). Reruns agree.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytegram.llm.common import WORD, only, written
from bytegram.llm.numbering import numbered


def n_words(text: str = "text") -> Column:
    """Words of a text, as a long (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, size``.

    Sources in order of code point (null last) have these weights, in turn, and share all sizes by them. A target stops
    at ``most`` times its source's size; the excess is shared out again by weight until no target is above that. The
    rounds keep two numbers: what is left to share, and the weights that share it.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.array(*[F.lit(w) for w in weights])
    sources = numbered(sources, [], [F.col("source").asc_nulls_last()], "sources")
    sources = written(sources.select("source", "source_size", F.get(turn, (F.col("pos") % len(weights)).cast("int")).alias("weight")),
                      "sources")
    whole, weight, capped = *sources.agg(F.sum("source_size"), F.sum("weight")).first(), 0
    rest = whole
    while whole:
        full = F.col("weight") * F.lit(float(rest)) / F.lit(float(weight)) > most * F.col("source_size")
        now, held, open_weight = sources.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)),
                                             F.sum(F.when(~full, F.col("weight")))).first()
        if now == capped:
            break
        rest, weight, capped = whole - most * held, open_weight, now
    share = F.col("weight") * F.lit(float(rest or 0)) / F.lit(float(weight or 1))
    return sources.select("source", "source_size", F.least(share, (most * F.col("source_size")).cast("double")).alias("target"))


def copies(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """``doc_id, text_hash, source, size, source_size, target, copies`` for every row of ``docs``.

    A null text has size 0, a null source is a source, null ids are ids; documents of no words are drawn like others and
    take nothing. Equal rows get copies one by one. An empty table gives no row.
    """
    sizes = written(only(docs, ("doc_id", "source", "text")).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        n_words().alias("size"), F.xxhash64("text").alias("text_hash")), "sizes")
    by_source = written(targets(sizes, weights, most), "targets")
    order = [F.col("size").asc(), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
                                       .cast("binary")).asc(), F.col("text_hash").asc()]
    rows = numbered(sizes, ["source"], order, "mix", by_source)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))
    uniform = F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    rows = rows.withColumn("rate", rate).withColumn("u", uniform).withColumn("fraction", F.col("rate") - F.floor("rate"))
    steps = F.floor((F.col("pos") + 1) * F.col("fraction") + F.col("u")) - F.floor(F.col("pos") * F.col("fraction") + F.col("u"))
    return rows.select("doc_id", "text_hash", "source", "size", "source_size", "target",
                       (F.floor("rate") + steps).alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it, with ``copy`` from 1.

    Rows with equal id, source and text are one row here, which is emitted as often as all of them together.
    """
    counts = (copies(docs, **options).groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").alias("_copies"))
              .filter("_copies > 0").withColumnsRenamed({"doc_id": "_id", "source": "_source", "text_hash": "_hash"}))
    keyed = docs.withColumn("_key", F.xxhash64("text")).dropDuplicates(["doc_id", "source", "_key"])
    same = (keyed["_key"] == counts["_hash"]) & keyed["doc_id"].eqNullSafe(counts["_id"]) & keyed["source"].eqNullSafe(counts["_source"])
    return (keyed.join(counts, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .drop("_id", "_source", "_hash", "_key", "_copies"))
