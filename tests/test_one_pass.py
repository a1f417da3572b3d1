"""Literal lists are answered from one scan; intervals of long and empty documents; spans without a shuffle."""
from collections import Counter

from bytegram.operators import count as CT
from bytegram.operators import find as FD
from bytegram.operators import retrieve as RT
from bytegram.operators import suffix as SX
from bytegram.plans.corpus import Corpus
from bytegram.session import scratch_path

from . import brute

TEXTS = ["the cat the", "", "x" * 70000 + "the end" + "ab" * 40000, "é the é"]
QUERIES = ["the", "x", "ab", "ba", "é", "zz", "the end" + "ab" * 20]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_of_a_list(spark):
    df = CT.count_literals(spark.createDataFrame([(t,) for t in TEXTS], "text string"), QUERIES)
    assert _plan(df).count("Scan") == 1
    assert {r["query"]: r["count"] for r in df.collect()} == {q: sum(brute.overlap_count(t, q) for t in TEXTS) for q in QUERIES}


def test_intervals_of_a_list(spark):
    c = Corpus.from_shards(spark, [TEXTS[:1], TEXTS[1:2], TEXTS[2:]])
    got = {(r["query"], r["shard"]): (r["lo"], r["hi"]) for r in FD.find_scan_many(c.layout, [*QUERIES, ""]).collect()}
    assert len(got) == 3 * (len(QUERIES) + 1)
    for s, texts in enumerate([TEXTS[:1], TEXTS[1:2], TEXTS[2:]]):
        data = b"".join(b"\xff" + t.encode() for t in texts) + b"\x00"
        assert got["", s] == (0, len(data))
        for q in QUERIES:
            b = q.encode()
            lo = sum(data[i:i + len(b)] < b for i in range(len(data)))
            assert got[q, s] == (lo, lo + sum(brute.overlap_count(t, q) for t in texts)), (q, s)


def test_spans_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a the b"), (2, None), (3, ""), (4, "thethe")], "k long, t string")
    rows = RT.highlight_rows(df, "k", "t", "the")
    assert "Exchange" not in _plan(rows)
    assert sorted((r["k"], r["span_ix"], r["fragment"], r["label"]) for r in rows.collect()) == [
        (1, 0, "a ", None), (1, 1, "the", "0"), (1, 2, " b", None), (4, 0, "the", "0"), (4, 1, "the", "0")]


def test_key_ranges_reach_the_index_scan(spark):
    c = Corpus.from_shards(spark, [TEXTS[:1], ["a b c d e f g", "aé zé \U0001f600"]])
    idx = spark.read.parquet(SX.build_index(c.layout, scratch_path(spark, "ranges-idx"), ranked=False))
    keys = [bytes(r["key"]) for r in idx.collect()]
    for heads in (["the", "a", "zé"], ["\U0001f600", "é", "e "], ["\x00", "\x7f"], ["", "c"]):
        q = spark.createDataFrame([(h.encode(),) for h in heads], "b binary")
        for limit in (1, 2, 64):
            near = SX.near_keys(idx, q, "b", limit)
            assert "PushedFilters" in (plan := _plan(near)) and "GreaterThanOrEqual(key" in plan.replace("[", "").replace("]", "")
            got = Counter(bytes(r["key"]) for r in near.collect())
            assert all(got[k] == keys.count(k) for k in keys if any(h and k.startswith(h.encode()) for h in heads))
    assert SX.near_keys(idx, spark.createDataFrame([], "b binary"), "b").count() == 0
