"""Batch request table: ``count / find / get_doc_by_rank / search`` requests as rows of a DataFrame.

``requests``: ``req_id BIGINT, index STRING, query_type STRING, query STRING, s INT, rank BIGINT,
max_results INT, max_ctx_len INT`` (nullable; defaults 10 results and 200 bytes). Every request yields
result rows or one error row; branches run as batch operators and are unioned by name.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

from ..constants import (DEFAULT_MAX_CTX_LEN, DEFAULT_MAX_RESULTS, NEGATIVE, QUERY_TYPES, SHARD_RANGE,
                         SUFFIX_KEY_BYTES)
from ..functions.bytes import utf8
from ..operators import ordered as OD
from ..operators import retrieve as RT
from ..operators import suffix as SX
from ..operators.find import terminated_bytes


BROADCAST_REQUESTS = 1_000_000


def _filled(template: str, **columns: F.Column) -> F.Column:
    """A text with ``{name}`` places filled from columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[columns[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def validate(requests: DataFrame, index_names: list[str], num_shards: dict[str, int]) -> DataFrame:
    """Add ``error`` (NULL when the request is valid), in the order the checks apply."""
    known = F.col("index").isin(*index_names) if index_names else F.lit(False)
    shards = F.lit(None).cast("int")
    for name, n in num_shards.items():
        shards = F.when(F.col("index") == name, F.lit(n)).otherwise(shards)
    t = F.col("query_type")
    err = (F.when(F.col("index").isNull() | t.isNull() | F.col("query").isNull(),
                  F.lit("Missing required field: index, query_type and query are required."))
           .when(~known, F.concat(F.lit("Unknown index "), F.col("index"), F.lit(".")))
           .when(~t.isin(*QUERY_TYPES), F.concat(F.lit("Unknown query_type "), t,
                                                   F.lit(". Allowed: " + str(sorted(QUERY_TYPES)) + ".")))
           .when((t == "get_doc_by_rank") & (F.col("s").isNull() | F.col("rank").isNull()),
                 F.lit("get_doc_by_rank needs s and rank."))
           .when((t == "get_doc_by_rank") & ((F.col("s") < 0) | (F.col("s") >= shards)),
                 _filled(SHARD_RANGE, s=F.col("s"), n=shards))
           .when((t == "get_doc_by_rank") & (F.col("rank") < 0),
                 _filled(NEGATIVE, name=F.lit("rank"), value=F.col("rank")))
           .when(F.coalesce(F.col("max_ctx_len"), F.lit(0)) < 0,
                 _filled(NEGATIVE, name=F.lit("max_ctx_len"), value=F.col("max_ctx_len"))))
    return requests.withColumn("error", err)


def search_batch(index: DataFrame, layout: DataFrame, reqs: DataFrame, k: int = SUFFIX_KEY_BYTES) -> DataFrame:
    """First ``max_results`` hits of many queries, round-robin over shards, with windows.

    Queries up to K bytes: index rows are equi-joined with the (broadcast, bounded) request table on
    the first n key bytes, one join per distinct n. Longer queries: candidates share the whole K-byte key
    and are verified against the text. Per request, hits keep ``i = rank - lo`` and the first
    ``max_results`` by ``(i, shard)``, a per-group top-k planned as a window group limit.
    """
    r = (reqs.select("req_id", "query", F.coalesce("max_results", F.lit(DEFAULT_MAX_RESULTS)).alias("max_results"),
                     F.coalesce("max_ctx_len", F.lit(DEFAULT_MAX_CTX_LEN)).alias("max_ctx_len"))
         .withColumn("_qb", utf8("query")).withColumn("_n", F.octet_length("_qb")))
    # The request table is broadcast to the index scans only when its counted size is small.
    bc = F.broadcast if r.count() <= BROADCAST_REQUESTS else (lambda d: d)
    # Distinct lengths up to K bytes (at most K values) decide the prefixes to cut from the keys.
    short_lens = sorted(x["_n"] for x in r.filter((F.col("_n") >= 1) & (F.col("_n") <= k))
                        .select("_n").distinct().collect())
    parts = []
    cols = ["req_id", "query", "max_results", "max_ctx_len", "_n", "shard", "rank", "ptr", "doc_ix"]
    if short_lens:
        # One pass over the index: one row per (key, present length), equi-joined on (length, prefix).
        per = F.array(*[F.struct(F.lit(n).alias("n"), F.substring("key", 1, n).alias("pre")) for n in short_lens])
        near = SX.near_keys(index, r.filter((F.col("_n") >= 1) & (F.col("_n") <= k)), "_qb")
        pre = (near.select("shard", "rank", "ptr", "doc_ix", F.explode(per).alias("_x"))
               .select("shard", "rank", "ptr", "doc_ix", F.col("_x.n").alias("_n"), F.col("_x.pre").alias("_qb"))
               .filter(F.octet_length("_qb") == F.col("_n")))
        rs = bc(r.filter((F.col("_n") >= 1) & (F.col("_n") <= k)))
        parts.append(pre.join(rs, ["_n", "_qb"]).select(*cols))
    if r.filter(F.col("_n") > k).limit(1).count():
        # Longer queries: candidates share the whole K-byte key; verify the full query on the text.
        rl = bc(r.filter(F.col("_n") > k).withColumn("key", F.substring("_qb", 1, k)))
        docs = layout.select("doc_ix", "data_offset", terminated_bytes(layout).alias("_bt"))
        h = (SX.near_keys(index, rl, "_qb").join(rl, "key").join(docs, "doc_ix")
             .filter(F.expr("substring(_bt, ptr - data_offset, _n)") == F.col("_qb")))
        parts.append(h.select(*cols))
    if r.filter(F.col("_n") == 0).limit(1).count():
        # The empty query matches every suffix: its first hits are the lowest ranks of each shard,
        # generated per request and equi-joined with the index on (shard, rank).
        shard_list = sorted(x[0] for x in index.select("shard").distinct().collect())
        want = (r.filter(F.col("_n") == 0)
                .select("req_id", "query", "max_results", "max_ctx_len", "_n",
                        F.explode(F.array(*[F.lit(x) for x in shard_list])).alias("shard"),
                        F.explode(F.sequence(F.lit(0), F.greatest(F.col("max_results") - 1, F.lit(0)))).alias("rank"))
                .withColumn("rank", F.col("rank").cast("bigint")))
        parts.append(want.join(index.select("shard", "rank", "ptr", "doc_ix"), ["shard", "rank"]).select(*cols))
    if not parts:
        return None
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    # Hits of a query form one rank interval per shard, so its i-th hit in a shard is the i-th smallest
    # rank there. The filter on the row number itself, with a literal bound, lets Spark plan a partial per-group
    # top-k (window group limit) before the shuffle, so a query with billions of hits never reaches one task whole.
    max_n = max(0, int(r.agg(F.max("max_results")).first()[0] or 0))
    w1 = Window.partitionBy("req_id", "shard").orderBy("rank")
    per_shard = (hits.withColumn("i", F.row_number().over(w1)).filter(F.col("i") <= F.lit(max_n))
                 .withColumn("i", F.col("i") - 1))
    w2 = Window.partitionBy("req_id").orderBy("i", "shard")
    top = per_shard.withColumn("hit", F.row_number().over(w2) - 1).filter(F.col("hit") < F.col("max_results"))
    out = RT.context_windows(top, layout, F.col("_n"), F.col("max_ctx_len"), keep=("req_id", "query", "hit", "rank"))
    return out.select("req_id", F.col("hit").cast("bigint").alias("hit"), F.col("shard").cast("bigint").alias("shard"),
                      "rank", "doc_ix", "doc_len", "disp_len", "needle_offset", "metadata", "text", "error",
                      RT.highlight_spans(F.col("text"), F.col("query")).alias("spans"))


def dispatch(corpora: dict, requests: DataFrame) -> DataFrame:
    """Answer a request table against named corpora.

    ``corpora``: ``name -> (Corpus, OrderedIndex)``, or with the ranked suffix table ``name -> (Corpus, table[, its prefix
    histogram])``. Output columns: ``req_id, query_type, count, shard, lo, hi, hit, rank, doc_ix, doc_len, disp_len,
    needle_offset, metadata, text, error, spans``.
    """
    names = list(corpora)
    shards = {n: len(c[1].shards) if isinstance(c[1], OD.OrderedIndex) else c[0].layout.select("shard").distinct().count()
              for n, c in corpora.items()}
    v = validate(requests, names, shards).checkpoint()
    out = [v.filter(F.col("error").isNotNull()).select("req_id", "query_type", "error")]
    ok = v.filter(F.col("error").isNull())
    for name, (corpus, index, *hist) in corpora.items():
        mine = ok.filter(F.col("index") == name)
        ordered = isinstance(index, OD.OrderedIndex)
        cnt = mine.filter(F.col("query_type") == "count")
        out.append(corpus.count_batch(cnt, qid="req_id", qcol="query")
                   .select(F.col("qid").alias("req_id"), F.lit("count").alias("query_type"), "count"))
        fnd = mine.filter(F.col("query_type") == "find")
        if ordered:
            found = OD.find(index, corpus.layout, fnd, "req_id", "query")
        elif hist:
            found = SX.find_batch_bucketed(index, hist[0], corpus.layout, fnd, qid="req_id", qcol="query")
        else:
            found = SX.find_batch_indexed(index, corpus.layout, fnd, qid="req_id", qcol="query")
        out.append(found.select(F.col("qid").alias("req_id"), F.lit("find").alias("query_type"), "shard", "lo", "hi"))
        gd = mine.filter(F.col("query_type") == "get_doc_by_rank").select(
            "req_id", "query", F.col("s").cast("int").alias("s"), "rank", F.octet_length(utf8("query")).alias("needle_len"),
            F.coalesce("max_ctx_len", F.lit(DEFAULT_MAX_CTX_LEN)).alias("max_ctx_len"))
        docs = (OD if ordered else RT).get_doc_by_rank(index, corpus.layout, gd).checkpoint()
        out.append(docs.select("req_id", F.lit("get_doc_by_rank").alias("query_type"),
                               F.col("shard").cast("bigint").alias("shard"), "rank", "doc_ix", "doc_len", "disp_len",
                               "needle_offset", "metadata", "text", "error", "spans"))
        # A rank past the end of its shard is an error row, not an abort.
        missing = gd.join(docs.select("req_id"), "req_id", "left_anti").select(
            "req_id", F.lit("get_doc_by_rank").alias("query_type"),
            F.concat(F.lit("rank "), F.col("rank").cast("string"), F.lit(" is out of range for shard "),
                     F.col("s").cast("string"), F.lit(".")).alias("error"))
        out.append(missing)
        srch = (OD.search_batch if ordered else search_batch)(index, corpus.layout, mine.filter(F.col("query_type") == "search"))
        if srch is not None:
            out.append(srch.withColumn("query_type", F.lit("search")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o, allowMissingColumns=True)
    return res
