"""Retrieval: match positions, documents of positions, context windows, ranked hits, search."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import DEFAULT_MAX_CTX_LEN, DEFAULT_MAX_RESULTS, NEGATIVE, SUFFIX_KEY_BYTES
from ..functions.bytes import lit_bytes, successor, utf8
from .find import terminated_bytes

# Fixed value: the error text of a window that cannot be decoded.
DECODE_ERROR = ("Failed to decode document text as UTF-8. The context window may be "
                "cut off mid-character. Try a different max_ctx_len.")

LOCATE_BUCKET_BYTES = 1 << 16


def match_positions(layout: DataFrame, q: str) -> DataFrame:
    """``shard, doc_ix, pos, ptr``: every (overlapping) occurrence; ``pos`` is the 0-based byte offset in
    the document, ``ptr`` the offset in the shard. Only documents that contain ``q`` are exploded."""
    qb = q.encode("utf-8")
    n = len(qb)
    if n == 0:
        raise ValueError("empty query")
    d = (layout.filter(F.contains(F.col("text"), F.lit(q)))
         .select("shard", "doc_ix", "data_offset", terminated_bytes(layout).alias("_b"),
                 F.explode(F.sequence(F.lit(1), F.col("doc_len").cast("int") - n + 1)).alias("_p")))
    return (d.filter(F.substring("_b", F.col("_p"), F.lit(n)) == lit_bytes(qb))
            .select("shard", "doc_ix", (F.col("_p") - 1).cast("bigint").alias("pos"),
                    (F.col("data_offset") + F.col("_p")).cast("bigint").alias("ptr")))


def locate_positions(positions: DataFrame, layout: DataFrame, bucket_bytes: int = LOCATE_BUCKET_BYTES) -> DataFrame:
    """Document of each ``(shard, ptr)``: the greatest ``data_offset <= ptr`` (the shard's sentinel belongs
    to its last document).

    Point-in-interval join without a range join: documents are exploded over the fixed-size byte buckets
    they overlap (a long document adds one row per bucket) and equi-joined on ``(shard, bucket)``.
    """
    last = (F.col("data_offset") + F.col("doc_len") + 2) == F.col("shard_bytes")
    iv = layout.select("shard", "doc_ix", F.col("data_offset").alias("_lo"),
                       (F.col("data_offset") + F.col("doc_len") + 1 + F.when(last, 1).otherwise(0)).alias("_hi"))
    iv = iv.select("shard", "doc_ix", "_lo", "_hi",
                   F.explode(F.sequence(F.floor(F.col("_lo") / bucket_bytes),
                                        F.floor((F.col("_hi") - 1) / bucket_bytes))).alias("_bkt"))
    p = positions.withColumn("_bkt", F.floor(F.col("ptr") / bucket_bytes))
    return (p.join(iv, ["shard", "_bkt"])
            .filter((F.col("ptr") >= F.col("_lo")) & (F.col("ptr") < F.col("_hi")))
            .drop("_bkt", "_lo", "_hi"))


def window_columns(needle_len: Column, max_ctx: Column) -> list[Column]:
    """Context window of a hit ``ptr`` inside its document (all in bytes), as in get_doc_by_rank.

    Requires ``ptr, data_offset, doc_len, text``. A separator position yields a window starting at the
    document start with ``needle_offset`` 0; a window cut inside a character yields ``error``."""
    doc_start = F.col("data_offset") + 1
    doc_end = doc_start + F.col("doc_len")
    disp_start = F.greatest(doc_start, F.greatest(F.col("ptr") - max_ctx, F.lit(0)))
    disp_end = F.least(doc_end, F.col("ptr") + needle_len + max_ctx)
    disp_len = F.greatest(disp_end - disp_start, F.lit(0))
    win = F.substring(utf8("text"), (disp_start - doc_start + 1).cast("int"), disp_len.cast("int"))
    txt = F.try_validate_utf8(win.cast("string"))
    return [
        F.col("doc_len").cast("bigint").alias("doc_len"),
        disp_len.cast("bigint").alias("disp_len"),
        F.greatest(F.col("ptr") - disp_start, F.lit(0)).cast("bigint").alias("needle_offset"),
        txt.alias("text"),
        F.when(txt.isNull(), F.lit(DECODE_ERROR)).alias("error"),
    ]


def context_windows(hits: DataFrame, layout: DataFrame, needle_len: int | Column,
                    max_ctx_len: int | Column = DEFAULT_MAX_CTX_LEN, with_metadata: bool = True,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """Join hits (``shard, ptr, doc_ix`` + ``keep``) to their documents and cut windows."""
    nl = needle_len if isinstance(needle_len, Column) else F.lit(needle_len)
    mc = max_ctx_len if isinstance(max_ctx_len, Column) else F.lit(max_ctx_len)
    docs = layout.select("doc_ix", "data_offset", "doc_len", F.col("text"),
                         F.col("metadata") if with_metadata else F.lit("").alias("metadata"))
    j = hits.join(docs, "doc_ix")
    return j.select(*keep, "shard", "ptr", "doc_ix", *window_columns(nl, mc),
                    F.when(F.col("data_offset").isNotNull(), F.col("metadata")).alias("metadata"))


def check_limits(max_ctx_len: int, needle_len: int = 0) -> None:
    """Raise for lengths that no request may have."""
    for name, value in (("needle_len", needle_len), ("max_ctx_len", max_ctx_len)):
        if value < 0:
            raise ValueError(NEGATIVE.format(name=name, value=value))


# ---- ranked access -------------------------------------------------------------------------------

def ranked_hits(index: DataFrame, q: str, max_per_shard: int | None = None,
                k: int = SUFFIX_KEY_BYTES, layout: DataFrame | None = None) -> DataFrame:
    """``shard, rank, i, ptr, doc_ix``: occurrences of ``q`` in rank order per shard; ``i = rank - lo``. With
    ``max_per_shard`` only the first hits of each shard are kept.

    A query over K bytes has its candidates in one key; they are verified on the text, so it needs ``layout``.
    """
    qb = q.encode("utf-8")
    if len(qb) > k:
        if layout is None:
            raise ValueError("a query of more than K bytes needs the corpus table")
        docs = layout.select("doc_ix", "data_offset", terminated_bytes(layout).alias("_bt"))
        m = (index.filter(F.col("key") == lit_bytes(qb[:k])).join(docs, "doc_ix")
             .filter(F.expr("substring(_bt, ptr - data_offset, %d)" % len(qb)) == lit_bytes(qb)))
    elif qb:
        m = index.filter((F.col("key") >= lit_bytes(qb)) & (F.col("key") < lit_bytes(successor(qb))))
    else:
        m = index
    # Hits of one query form one rank interval per shard, so i = rank - min(rank): a partial aggregate
    # (one row per shard), no window over a whole shard.
    lo = m.groupBy("shard").agg(F.min("rank").alias("_lo"))
    m = (m.join(F.broadcast(lo), "shard")
         .select("shard", "rank", "ptr", "doc_ix", (F.col("rank") - F.col("_lo")).cast("bigint").alias("i")))
    if max_per_shard is not None:
        m = m.filter(F.col("i") < max_per_shard)
    return m


def search_round_robin(index: DataFrame, q: str, max_results: int = DEFAULT_MAX_RESULTS,
                       layout: DataFrame | None = None) -> DataFrame:
    """First ``max_results`` hits taken round-robin over shards: order by ``(i, shard)``."""
    max_results = max(0, max_results)
    h = ranked_hits(index, q, max_per_shard=max_results, layout=layout)
    return h.orderBy("i", "shard").limit(max_results)


def search(index: DataFrame, layout: DataFrame, q: str, max_results: int = DEFAULT_MAX_RESULTS,
           max_ctx_len: int = DEFAULT_MAX_CTX_LEN, get_metadata: bool = True) -> DataFrame:
    """``hit, shard, rank, doc_ix, doc_len, disp_len, needle_offset, metadata, text, error, spans`` for the first
    ``max_results`` hits; only those few rows are joined to the corpus (bounded broadcast)."""
    top = search_round_robin(index, q, max_results, layout)
    top = top.withColumn("hit", F.row_number().over(Window.orderBy("i", "shard")) - 1)
    w = context_windows(F.broadcast(top), layout, len(q.encode("utf-8")), max_ctx_len,
                        with_metadata=get_metadata, keep=("hit", "rank"))
    return w.select(F.col("hit").cast("bigint").alias("hit"), F.col("shard").cast("bigint").alias("shard"),
                    "rank", "doc_ix", "doc_len", "disp_len", "needle_offset", "metadata", "text", "error",
                    highlight_spans(F.col("text"), q).alias("spans"))


def get_doc_by_rank(index: DataFrame, layout: DataFrame, requests: DataFrame,
                    get_metadata: bool = True) -> DataFrame:
    """Batch form: ``requests(req_id, s, rank, needle_len, max_ctx_len)`` → one hit row per request that
    names an existing rank; the row holds the document window as in :func:`context_windows`. Requests with a
    ``query`` column get its highlighted ``spans`` too."""
    # The ranked index is sorted by (shard, rank): bounding the scan by the requested ranks (two scalars)
    # lets the Parquet reader skip every row group outside them.
    b = requests.agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).first()
    idx = index
    if b is not None and b["lo"] is not None:
        idx = index.filter((F.col("rank") >= F.lit(int(b["lo"]))) & (F.col("rank") <= F.lit(int(b["hi"]))))
    look = requests.join(idx.select(F.col("shard").alias("s"), "rank", "ptr", "doc_ix"), ["s", "rank"])
    look = look.withColumnRenamed("s", "shard")
    needle = ("query",) if "query" in requests.columns else ()
    w = context_windows(look, layout, F.col("needle_len"), F.col("max_ctx_len"), with_metadata=get_metadata,
                        keep=("req_id", "rank", "needle_len", "max_ctx_len", *needle))
    if needle:
        w = w.withColumn("spans", highlight_spans(F.col("text"), F.col("query")))
    return w.drop("needle_len", "max_ctx_len", *needle)


# ---- concordance output ---------------------------------------------------------------------------

def highlight_spans(text: Column, needle: str | Column) -> Column:
    """``ARRAY<STRUCT<fragment, label>>``: leftmost non-overlapping occurrences labelled ``'0'``, other text
    unlabelled, empty fragments dropped; an empty needle gives the whole text as one span, a null text gives null."""
    from ..constants import HIGHLIGHT_LABEL
    from ..functions.bytes import regex_quote
    found = F.lit(needle) if isinstance(needle, str) else needle
    plain = lambda t: F.struct(t.alias("fragment"), F.lit(None).cast("string").alias("label"))
    marked = F.struct(found.alias("fragment"), F.lit(HIGHLIGHT_LABEL).alias("label"))
    if isinstance(needle, str):
        pattern = F.lit(regex_quote(needle))
    else:
        pattern = F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    parts = F.split(text, pattern, -1)
    pieces = F.transform(parts, lambda p, i: F.when(i == 0, F.array(plain(p))).otherwise(F.array(marked, plain(p))))
    spans = F.filter(F.flatten(pieces), lambda s: s["fragment"] != F.lit(""))
    return F.when(text.isNotNull(), F.when(found == "", F.array(plain(text))).otherwise(spans))


def highlight_rows(df: DataFrame, key: str, text_col: str, needle: str) -> DataFrame:
    """Exploded form of :func:`highlight_spans`: ``key, span_ix, fragment, label``, from one scan without a shuffle.
    A null text gives no rows."""
    return (df.select(key, F.posexplode(highlight_spans(F.col(text_col), needle)).alias("span_ix", "_s"))
            .select(key, F.col("span_ix").cast("bigint").alias("span_ix"), "_s.fragment", "_s.label"))


def kwic_text(text: Column, needle: str, indent: str = "    ") -> Column:
    """Marked text: every occurrence wrapped as ``>>>q<<<``, surrounding whitespace stripped, and every
    line that holds a non-whitespace character indented. Whitespace and line ends are Unicode's."""
    marked = F.replace(text, F.lit(needle), F.lit(">>>" + needle + "<<<")) if needle else text
    ends = r"\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029"
    blank = ends + r"\t \x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
    stripped = F.regexp_replace(marked, rf"\A[{blank}]+|[{blank}]+\z", "")
    begin = rf"(?:\A|(?<=[{ends}&&[^\r]])|(?<=\r)(?!\n))"
    return F.regexp_replace(stripped, rf"{begin}(?=[^{ends}]*[^{blank}])", indent)


def source_label(metadata: Column) -> Column:
    """A human label for a hit: the record's ``source`` field, else its file path, else the raw JSON."""
    return F.coalesce(F.get_json_object(metadata, "$.metadata.source"), F.get_json_object(metadata, "$.source"),
                      F.get_json_object(metadata, "$.path"), metadata)
