"""Occurrence counting (overlapping, byte-exact)."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..constants import SEED_BYTES
from ..functions.bytes import byte_len, occurrences, utf8
from .positions import chunks, grams_multi

# Query tables beyond this size are joined by a shuffle of their pieces instead of a broadcast.
QUERY_BROADCAST_BYTES = 64 << 20
# Queries, and bytes of them, that tasks look for in whole stretches of text; more of them meet the grams in a join.
LOOKED_FOR, LOOKED_FOR_BYTES = 50_000, 4 << 20
# Bytes of text that a task looks at together.
STRETCH_BYTES = 2 << 20
# Words (64 bits) of the filter of query pieces at most: its broadcast is bounded whatever the query table's size.
FILTER_WORDS = 1 << 21
PIECES_PER_WORD = 4


def count_literal(docs: DataFrame, q: str) -> DataFrame:
    """``query, count``: overlapping occurrences of ``q`` over all documents (one row)."""
    if q == "":
        raise ValueError("the empty query counts corpus bytes; use count_empty")
    return (docs.filter(F.contains(F.col("text"), F.lit(q)))
            .agg(F.coalesce(F.sum(occurrences("text", q)), F.lit(0)).cast("bigint").alias("count"))
            .select(F.lit(q).alias("query"), "count"))


def count_literals(docs: DataFrame, queries: list[str]) -> DataFrame:
    """``query, count`` for a short literal list of non-empty queries, from one scan of the texts."""
    qs = list(dict.fromkeys(queries))
    sums = [F.coalesce(F.sum(occurrences("text", q)), F.lit(0)).cast("bigint").alias(f"_c{j}") for j, q in enumerate(qs)]
    rows = [F.struct(F.lit(q).alias("query"), F.col(f"_c{j}").alias("count")) for j, q in enumerate(qs)]
    return docs.agg(*sums).select(F.inline(F.array(*rows)))


def count_by_shard(layout: DataFrame, q: str) -> DataFrame:
    """``shard, count`` for every shard (zero where absent); the empty query counts the shard's bytes."""
    if q == "":
        return layout.groupBy(F.col("shard").cast("bigint").alias("shard")).agg(
            (F.sum(F.col("doc_len") + 1) + 1).cast("bigint").alias("count"))
    hits = (layout.filter(F.contains(F.col("text"), F.lit(q)))
            .groupBy("shard").agg(F.sum(occurrences("text", q)).alias("_c")))
    shards = layout.select("shard").distinct()
    return (shards.join(hits, "shard", "left")
            .select(F.col("shard").cast("bigint").alias("shard"),
                    F.coalesce(F.col("_c"), F.lit(0)).cast("bigint").alias("count")))


def count_empty(layout: DataFrame) -> DataFrame:
    """The empty query matches every suffix: sum over shards of (bytes incl. separators) + sentinel."""
    per = layout.groupBy("shard").agg((F.sum(F.col("doc_len") + 1) + 1).alias("_b"))
    return per.agg(F.sum("_b").cast("bigint").alias("count")).select(F.lit("").alias("query"), "count")


def docs_containing(docs: DataFrame, q: str) -> DataFrame:
    """Documents with at least one occurrence, with their occurrence count."""
    return (docs.filter(F.contains(F.col("text"), F.lit(q)))
            .select("doc_ix", occurrences("text", q).alias("count")))


def _query_table(queries: DataFrame, qid: str, qcol: str) -> DataFrame:
    return queries.select(F.col(qid).cast("bigint").alias("qid"), F.col(qcol).alias("query")) \
        .withColumn("qb", utf8("query")).withColumn("n", byte_len("query"))


def seed_pieces(q: DataFrame, s: int) -> DataFrame:
    """Cut each query (``n >= s``) into ``s``-byte pieces at offsets 0, s, 2s, … and n-s; together they
    cover every byte, so a position matches the query iff every piece matches at its offset."""
    offs = F.array_distinct(F.array_union(F.sequence(F.lit(0), F.col("n") - s, F.lit(s)),
                                          F.array(F.col("n") - s)))
    return (q.select("qid", "qb", "n", offs.alias("_offs"))
            .select("qid", "qb", F.size("_offs").alias("m"), F.explode("_offs").alias("o"))
            .select("qid", "m", F.col("o").cast("int").alias("o"),
                    F.substring("qb", F.col("o") + 1, F.lit(s)).alias("piece")))


def _anchors(q: DataFrame, pieces: DataFrame) -> DataFrame:
    """``qid, qb, n, s, o, piece``: of each query's pieces, the one that fewest queries share."""
    shared = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("_share"))
    best = (pieces.join(shared, "piece").groupBy("qid")
            .agg(F.min(F.struct("_share", "o", "s", "piece")).alias("_a")))
    return q.join(best, "qid").select("qid", "qb", "n", "_a.s", "_a.o", "_a.piece")


def _word_and_mask(value: str, words: int):
    """Number of a value's word in a filter of ``words`` words, and its four bits there."""
    h = F.xxhash64(value)
    bit = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
           for i in range(4)]
    return (F.pmod(F.shiftrightunsigned(h, 24), F.lit(words)).alias("_word"),
            bit[0].bitwiseOR(bit[1]).bitwiseOR(bit[2]).bitwiseOR(bit[3]).alias("_mask"))


def known_grams(g: DataFrame, pieces: DataFrame, words: int) -> DataFrame:
    """Rows of ``g`` whose ``gram`` is in ``pieces``, and about one in a hundred others: a blocked Bloom filter, a block a word.

    No true match is lost. The filter has at most ``words`` rows and is tested in the task that made the gram.
    """
    bits = pieces.select(*_word_and_mask("piece", words)).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    mask = F.col("_mask")
    return (g.select("*", *_word_and_mask("gram", words)).join(F.broadcast(bits), "_word")
            .filter(F.col("_bits").bitwiseAND(mask) == mask).drop("_word", "_mask", "_bits"))


def _all_pieces(q: DataFrame, seed_bytes: int) -> tuple[DataFrame, list[int]]:
    """``seed_pieces`` of all queries with their length ``s``, and the lengths in use (at most ``seed_bytes`` many)."""
    classes = sorted(r["s"] for r in q.select(F.least(F.col("n"), F.lit(seed_bytes)).alias("s")).distinct().collect())
    pieces = None
    for s in classes:
        ps = seed_pieces(q.filter(F.least(F.col("n"), F.lit(seed_bytes)) == s), s).withColumn("s", F.lit(s))
        pieces = ps if pieces is None else pieces.unionByName(ps)
    return pieces, classes


def _looker(anchors: list[tuple]):
    """Of chunks ``own, cb``: ``qid, cnt`` of ``anchors (qid, qb, n, s, o, piece)``, for some megabytes at a time.

    Every place is tested for each length ``s`` in use by a table of hashed pieces; the few that may begin a piece are looked up, and of these
    the starts of longer queries compared eight bytes at a time.
    """
    import numpy as np

    def number(b: bytes) -> int:
        return int.from_bytes(b[:8], "little")

    def mixed(v):
        return (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)

    lengths = {}
    for qid, qb, n, s, o, piece in anchors:
        lengths.setdefault(s, {}).setdefault(number(piece), []).append((qid, qb, n, o, qb == piece))
    known = []
    for s, pieces in sorted(lengths.items()):
        values = np.array(sorted(pieces), np.uint64)
        table = np.zeros(1 << 16, bool)
        table[mixed(values)] = True
        known.append((s, np.uint64((1 << 8 * s) - 1), values, table, [pieces[int(v)] for v in values]))

    def count(chunk: list[tuple[int, bytes]], counts: dict) -> None:
        own = np.array([c[0] for c in chunk])
        size = np.array([len(c[1]) for c in chunk])
        begin = np.cumsum(size) - size
        data = b"".join(c[1] for c in chunk) + bytes(8)
        words = np.ndarray((len(data) - 8,), "<u8", data, strides=(1,))
        bare = words.astype(np.uint64)

        def owned(starts, n):
            """Those where a query of ``n`` bytes starts at a chunk's own place and ends inside the chunk; ``starts`` with their chunks."""
            at, of = starts
            inside = at - begin[of]
            return at[(inside >= 0) & (inside < own[of]) & (inside + n <= size[of])]

        for s, mask, values, table, queries in known:
            v = bare & mask
            at = np.flatnonzero(table[mixed(v)])
            found = np.searchsorted(values, v[at])
            hit = values[np.minimum(found, len(values) - 1)] == v[at]
            at, found = at[hit], found[hit]
            if not len(at):
                continue
            of = np.searchsorted(begin, at, "right") - 1
            fits = at + s <= begin[of] + size[of]
            at, found, of = at[fits], found[fits], of[fits]
            order = np.argsort(found, kind="stable")
            at, of = at[order], of[order]
            ends = np.cumsum(np.bincount(found, minlength=len(values)))
            for i, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
                for qid, qb, n, o, whole in queries[i] if a < b else ():
                    starts = owned((at[a:b] - o, of[a:b]), n)
                    if not whole:
                        for j in [*range(0, n - 7, 8), *([n - 8] if n >= 8 else [])]:
                            starts = starts[bare[starts + j] == np.uint64(number(qb[j:j + 8]))]
                        if n < 8:
                            starts = starts[bare[starts] & np.uint64((1 << 8 * n) - 1) == np.uint64(number(qb))]
                    if len(starts):
                        counts[qid] = counts.get(qid, 0) + len(starts)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = {}, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for own, cb in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    # an empty chunk, or one of empty bytes, has no place
                    if own and cb:
                        held.append((own, cb))
                        size += len(cb)
                    if size >= STRETCH_BYTES:
                        count(held, counts)
                        held, size = [], 0
        if held:
            count(held, counts)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["qid", "cnt"])
    return look


def _count_anchored(docs: DataFrame, q: DataFrame, maxn: int, seed_bytes: int, few: bool = False) -> DataFrame:
    """``qid, cnt`` of queries that are small enough together to be broadcast; of a ``few``, without a row for each gram."""
    pieces, classes = _all_pieces(q, seed_bytes)
    if few and classes[-1] <= 8:
        anchors = [(r["qid"], bytes(r["qb"]), r["n"], r["s"], r["o"], bytes(r["piece"])) for r in _anchors(q, pieces).collect()]
        found = chunks(docs, overlap=maxn - 1).select(F.col("own").cast("int"), "cb").mapInArrow(_looker(anchors), "qid long, cnt long")
        return found.groupBy("qid").agg(F.sum("cnt").alias("cnt"))
    pj = F.broadcast(_anchors(q, pieces))
    # Pieces of the longest class may sit up to maxn - s bytes after an owned start.
    g = grams_multi(chunks(docs, overlap=maxn - 1), classes, maxn - classes[-1], keep=("cb",))
    start = F.col("p") - F.col("o")
    j = g.join(pj, (g["s"] == pj["s"]) & (g["gram"] == pj["piece"]) & (start >= 1) & (start <= F.col("own"))
               & (F.substring("cb", start, F.col("n")) == F.col("qb")))
    return j.groupBy("qid").agg(F.count(F.lit(1)).alias("cnt"))


def _count_pieces(docs: DataFrame, q: DataFrame, n_pieces: int, seed_bytes: int) -> DataFrame:
    """``qid, cnt`` of any number of queries of any length: chunks reach one piece further, pieces meet by place in the document."""
    pieces, classes = _all_pieces(q, seed_bytes)
    g = grams_multi(chunks(docs, overlap=classes[-1] - 1), classes, keep=("cstart",))
    g = known_grams(g, pieces, max(1, min(FILTER_WORDS, -(-n_pieces // PIECES_PER_WORD))))
    j = (g.join(pieces, (g["s"] == pieces["s"]) & (g["gram"] == pieces["piece"]))
         .withColumn("start", F.col("cstart") + F.col("p") - F.col("o")).filter(F.col("start") >= 1))
    single = j.filter(F.col("m") == 1).groupBy("qid").agg(F.count(F.lit(1)).alias("cnt"))
    multi = (j.filter(F.col("m") > 1)
             .groupBy("doc_ix", "start", "qid", "m").agg(F.count(F.lit(1)).alias("_k"))
             .filter(F.col("_k") == F.col("m"))
             .groupBy("qid").agg(F.count(F.lit(1)).alias("cnt")))
    return single.unionByName(multi)


def count_batch(docs: DataFrame, queries: DataFrame, qid: str = "qid", qcol: str = "query",
                empty_count: DataFrame | None = None, seed_bytes: int = SEED_BYTES,
                broadcast_bytes: int = QUERY_BROADCAST_BYTES) -> DataFrame:
    """``qid, query, count`` for a whole table of queries; absent queries count 0, order is by ``qid``.

    Plan: queries of byte length n use seeds of s = min(n, seed_bytes) bytes. Document positions are exploded
    once into grams of the lengths in use (chunked documents, positions stay inside one task) and equi-joined
    with the query pieces. Of at most ``LOOKED_FOR`` queries, the places of a stretch of text are tested for their pieces at once instead, and
    make no rows (:func:`_looker`). A query table whose summed size is at most ``broadcast_bytes`` is broadcast: each query
    is anchored at its piece that fewest queries share and compared as a whole with the chunk in the same task, and
    only counts by query are shuffled. A larger table is joined by a shuffle of pieces: grams pass a broadcast filter of
    the pieces first, so that only candidates are shuffled; chunks reach one piece further, however long a query is;
    the (document, start, query) groups with all pieces present are the matches. Partial aggregation happens
    before every shuffle.
    """
    q = _query_table(queries, qid, qcol)
    st = q.agg(F.max("n").alias("maxn"), F.sum("n").alias("tot"), F.count(F.lit(1)).alias("cnt"),
               F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("empties")).first()
    maxn, total_bytes, n_queries = (int(st[k] or 0) for k in ("maxn", "tot", "cnt"))
    some, counts = q.filter(F.col("n") > 0), []
    if maxn and total_bytes + 96 * n_queries <= broadcast_bytes:
        few = n_queries <= LOOKED_FOR and total_bytes <= LOOKED_FOR_BYTES
        counts.append(_count_anchored(docs, some, maxn, seed_bytes, few))
    elif maxn:
        counts.append(_count_pieces(docs, some, total_bytes // seed_bytes + 2 * n_queries, seed_bytes))
    out = q.select("qid", "query", "n")
    if counts:
        allc = counts[0]
        for c in counts[1:]:
            allc = allc.unionByName(c)
        allc = allc.groupBy("qid").agg(F.sum("cnt").alias("_cnt"))
        out = out.join(allc, "qid", "left")
    else:
        out = out.withColumn("_cnt", F.lit(None).cast("bigint"))
    if int(st["empties"] or 0) > 0:
        if empty_count is None:
            raise ValueError("batch holds the empty query; pass empty_count (corpus bytes)")
        # One scalar (corpus bytes) read back to the driver.
        total = _scalar(empty_count.select("count"))
        out = out.withColumn("_cnt", F.when(F.col("n") == 0, F.lit(total)).otherwise(F.col("_cnt")))
    return out.select("qid", "query", F.coalesce(F.col("_cnt"), F.lit(0)).cast("bigint").alias("count"))


def _scalar(df: DataFrame) -> int:
    return int(df.first()[0])
