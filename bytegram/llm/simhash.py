"""SimHash near-duplicates by deletion-variant signatures.

The 64 bits are cut into three segments. Two fingerprints at four or fewer differing bits have a segment in which they
differ in at most one bit. So each distinct fingerprint is indexed under 64 keys: a segment with one bit made a
wildcard, for each bit. An equality join on these keys finds all candidates; the join's own condition counts the
differing bits and accepts a pair under one key only, so that only verified links leave it, once each.

Exact copies meet as one fingerprint before any join. Null and empty texts have fingerprint zero, which links like any
other. Repeated rows are kept. Null ids take part; a component whose ids are all null has a null id.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytegram.llm.common import sorted_join, written
from bytegram.llm.components import components

#: First bit and length of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_PASS = 1 << 15


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles of a text; A-Z are lower-cased."""
    from xxhash import xxh64_digest

    words = text.lower().split()  # for bytes: only ASCII letters, and exactly the ASCII white space
    if not words:
        return 0
    text, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    spans = list(zip(begins[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(spans), _PASS):
        raw = b"".join([xxh64_digest(text[a:b], 42) for a, b in spans[at:at + _PASS]])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255
        if whole:
            ones += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(spans)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, text_hash, fp`` of each row of ``documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            made = [fingerprint(t.as_py() or b"", shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.int64())],
                                             names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, text_hash long, fp long")


def _segment(x: Column, first: int, length: int) -> Column:
    return F.shiftrightunsigned(x, first).bitwiseAND(F.lit((1 << length) - 1))


def links(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """``a, b``: all pairs of the distinct fingerprints ``fp`` with at most ``max_bits`` (up to 5) differing bits."""
    if max_bits >= 2 * len(SEGMENTS):
        raise ValueError("three segments find at most five differing bits")
    bit = F.col("bit")
    rest = None
    for first, length in SEGMENTS[::-1]:
        own = _segment(F.col("fp"), first, length).bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, bit - {first})")))
        rest = own if rest is None else F.when(bit < first + length, own).otherwise(rest)
    keyed = (distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
             .select("fp", "bit", (F.shiftleft(bit.cast("long"), 22) + rest).alias("key")))
    a, b = keyed.alias("a"), keyed.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    bit = F.col("a.bit")
    accepted, earlier = F.lit(False), F.lit(True)
    for first, length in SEGMENTS:
        part = _segment(x, first, length)
        here = (bit >= first) & (bit < first + length) & (
            ((part == 0) & (bit == first)) | (part == F.expr(f"shiftleft(1L, a.bit - {first})")))
        accepted = accepted | (earlier & here)
        earlier = earlier & (F.bit_count(part) >= 2)
    # 64 keys for each fingerprint: Spark sizes them as if they were one, and would broadcast them
    found = a.join(sorted_join(b), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
                   & (F.bit_count(x) <= max_bits) & accepted)
    return found.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``doc_id, text_hash, fingerprint, component_id, kept`` of each row.

    ``component_id`` is the smallest id of the component; ``kept`` is true for the rows of its first document (the
    smallest id, then the smallest hash of the text; rows that repeat that document as a whole are all true).
    """
    prints = written(fingerprints(docs, shingle), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    distinct = written(prints.groupBy("fp").agg(first), "simhash")
    joined = components(links(distinct, max_bits))
    group = F.coalesce("component", "fp")
    named = written(distinct.join(sorted_join(joined), distinct["fp"] == joined["node"], "left")
                    .select("fp", group.alias("component"), "first"), "simhash")
    firsts = named.groupBy("component").agg(F.min("first").alias("lead"))
    named = named.join(sorted_join(firsts), "component").select("fp", "lead")
    return prints.join(sorted_join(named), "fp").select(
        "doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("lead.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("text_hash") == F.col("lead.text_hash"))).alias("kept"))
