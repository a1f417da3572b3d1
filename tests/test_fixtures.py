"""Tiny corpora with hand-checked answers (FIXTURES.md §3)."""
import pytest
from pyspark.sql import functions as F

from bytegram import Corpus
from bytegram.operators import find as FD
from bytegram.operators import retrieve as RT
from bytegram.operators import suffix as SX

C1 = [["aaaa", "ab", "ba", ""]]
C2 = [["ab", "ab", "aba"], ["ab", "b"]]
C3 = [["é€😀é", "naïve café", "cafe"]]


@pytest.fixture(scope="module")
def corpora(spark):
    out = {}
    for name, shards in (("C1", C1), ("C2", C2), ("C3", C3)):
        c = Corpus.from_shards(spark, shards)
        lay = c.layout.checkpoint()
        rows = SX.suffix_rows(lay)
        idx = SX.exact_ranks(rows).checkpoint()
        out[name] = (c, lay, idx)
    return out


def test_sizes(corpora):
    assert [r["shard_bytes"] for r in corpora["C1"][1].select("shard_bytes").distinct().collect()] == [13]
    sizes = {r["shard"]: r["shard_bytes"] for r in corpora["C2"][1].select("shard", "shard_bytes").distinct().collect()}
    assert sizes == {0: 11, 1: 6}
    assert corpora["C3"][1].select("shard_bytes").first()[0] == 31


@pytest.mark.parametrize("name,q,count,intervals", [
    ("C1", "a", 6, [(1, 7)]), ("C1", "aa", 3, [(1, 4)]), ("C1", "ab", 1, [(4, 5)]), ("C1", "ba", 1, [(7, 8)]),
    ("C1", "zz", 0, [(9, 9)]), ("C1", "", 13, [(0, 13)]),
    ("C2", "ab", 4, [(2, 5), (1, 2)]), ("C2", "b", 5, [(5, 8), (2, 4)]), ("C2", "aba", 1, [(2, 3), (1, 1)]),
    ("C2", "", 17, [(0, 11), (0, 6)]),
    ("C3", "é", 3, [(22, 25)]), ("C3", "caf", 2, [(5, 7)]), ("C3", "😀", 1, [(27, 28)]), ("C3", "café", 1, [(6, 7)]),
])
def test_count_and_find(corpora, name, q, count, intervals):
    c, lay, idx = corpora[name]
    assert c.count(q).first()["count"] == count
    scan = sorted((r["shard"], r["lo"], r["hi"]) for r in FD.find_scan(lay, q).collect())
    assert [(lo, hi) for _, lo, hi in scan] == intervals
    ind = sorted((r["shard"], r["lo"], r["hi"]) for r in SX.find_indexed(idx, lay, q).collect())
    assert ind == scan
    hist = idx.groupBy("shard", F.substring("key", 1, 2).alias("p2")).agg(F.count(F.lit(1)).alias("cnt"))
    ind2 = sorted((r["shard"], r["lo"], r["hi"]) for r in SX.find_indexed(idx, lay, q, hist=hist).collect())
    assert ind2 == scan
    if q:
        many = sorted((r["shard"], r["lo"], r["hi"]) for r in FD.find_scan_many(lay, [q]).collect())
        assert many == scan


def _search(idx, lay, q, n, ctx):
    rows = RT.search(idx, lay, q, n, ctx).orderBy("hit").collect()
    return [(r["shard"], r["rank"], r["doc_ix"], r["doc_len"], r["disp_len"], r["needle_offset"],
             r["text"] if r["error"] is None else "error") for r in rows]


def test_search_round_robin_copies(corpora):
    c, lay, idx = corpora["C2"]
    assert _search(idx, lay, "ab", 4, 1) == [
        (0, 2, 2, 3, 3, 0, "aba"), (1, 1, 3, 2, 2, 0, "ab"), (0, 3, 1, 2, 2, 0, "ab"), (0, 4, 0, 2, 2, 0, "ab")]


def test_search_cut_characters(corpora):
    c, lay, idx = corpora["C3"]
    assert _search(idx, lay, "é", 5, 2) == [
        (0, 22, 0, 11, 4, 0, "error"), (0, 23, 1, 12, 4, 2, "afé"), (0, 24, 0, 11, 4, 2, "error")]
    assert _search(idx, lay, "caf", 5, 1) == [(0, 5, 2, 4, 4, 0, "cafe"), (0, 6, 1, 12, 5, 1, "error")]


def test_search_empty_query_sentinel_first(corpora):
    c, lay, idx = corpora["C1"]
    assert _search(idx, lay, "", 2, 2) == [(0, 0, 3, 0, 0, 0, ""), (0, 1, 0, 4, 2, 0, "aa")]


@pytest.mark.parametrize("text,needle,spans", [
    ("aXbXXc", "X", [("a", None), ("X", "0"), ("b", None), ("X", "0"), ("X", "0"), ("c", None)]),
    ("aaa", "aa", [("aa", "0"), ("a", None)]),
    ("abc", "", [("abc", None)]),
    ("", "x", []),
])
def test_highlight(spark, text, needle, spans):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(RT.highlight_spans(F.col("t"), needle).alias("s")).first()["s"]
    assert [(x["fragment"], x["label"]) for x in got] == spans
    rows = RT.highlight_rows(df.withColumn("k", F.lit(1)), "k", "t", needle).orderBy("span_ix").collect()
    assert [(x["fragment"], x["label"]) for x in rows] == (spans if text or needle else [("", None)])
    assert [x["span_ix"] for x in rows] == list(range(len(rows)))


def test_get_doc_by_rank_separator_and_out_of_range(spark, corpora):
    c, lay, idx = corpora["C1"]
    # Ranks 9..12 are the separators (0xFF sorts last); their window starts at the document start.
    req = spark.createDataFrame([(1, 0, 12, 0, 2), (2, 0, 99, 1, 2)],
                                "req_id long, s int, rank long, needle_len long, max_ctx_len long")
    rows = {r["req_id"]: r for r in RT.get_doc_by_rank(idx, lay, req).collect()}
    assert 2 not in rows
    assert rows[1]["needle_offset"] == 0
