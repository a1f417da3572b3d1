"""The corpus table is pruned Parquet; batch counts agree on both plans; spans belong to hits."""
import random

from pyspark.sql import functions as F

from bytegram.operators import count as CT
from bytegram.operators import retrieve as RT
from bytegram.operators import suffix as SX
from bytegram.plans import registry as R
from bytegram.plans.corpus import Corpus
from bytegram.session import scratch_path

from . import brute

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_layout_scans_only_needed_columns(spark):
    c = R.documents(spark, SF)
    for df in (c.layout.groupBy("shard").count(), c.count("the")):
        plan = _plan(df)
        assert "Scan parquet" in plan and "metadata:string" not in plan and "bytes:binary" not in plan
    assert "PartitionFilters: [isnotnull(shard" in _plan(c.shard(1))
    assert "PushedFilters: [IsNotNull(doc_ix), EqualTo(doc_ix,3)]" in _plan(c.layout.filter("doc_ix = 3"))


def test_empty_corpus_has_a_layout(spark):
    docs = spark.createDataFrame([], "doc_ix long, path string, linenum long, text string, metadata string")
    assert Corpus(spark, docs, num_shards=3).layout.count() == 0


def test_count_batch_by_broadcast_and_by_shuffle(spark):
    texts = ["abababab" * 3, "the cat the cat", "é" * 30, "", "Question: a? Question: b?", "x" * 70000 + "needle in x"]
    queries = ["ab", "abababab", "abababababab", "the cat", "Question: a", "Question: b", "é" * 12, "zz", "needle in x",
               "x" * 40, "Question: a"]
    c = Corpus.from_shards(spark, [texts[:3], texts[3:]])
    q = spark.createDataFrame([*enumerate(queries)], "qid long, query string")
    want = {i: sum(brute.overlap_count(t, s) for t in texts) for i, s in enumerate(queries)}
    for limit in (CT.QUERY_BROADCAST_BYTES, 0):
        got = CT.count_batch(c.texts, q, broadcast_bytes=limit)
        assert {r["qid"]: r["count"] for r in got.collect()} == want


def test_count_batch_by_pieces_across_chunks(spark):
    long = "".join(random.Random(3).choices("abcé ", k=70_000))
    cut = len(long.encode()[:65_536].decode(errors="ignore"))
    texts = [long, "x" + long, "ab" * 40, long[cut - 150:cut + 150], ""]
    queries = [long[cut - 100:cut + 100], long[cut - 40:cut + 3], long[:1000], "ab" * 20, "é a", long[cut - 9:cut + 9] + "z", long[-20:]]
    c = Corpus.from_shards(spark, [texts[:2], texts[2:]])
    q = spark.createDataFrame([*enumerate(queries)], "qid long, query string")
    want = {i: sum(brute.overlap_count(t, s) for t in texts) for i, s in enumerate(queries)}
    got = CT.count_batch(c.texts, q, broadcast_bytes=0)
    assert {r["qid"]: r["count"] for r in got.collect()} == want and want[0] == 3


def test_filter_of_query_pieces_keeps_every_match_and_few_others(spark):
    grams = spark.range(200_000).select(F.col("id").cast("string").cast("binary").alias("gram"), "id")
    pieces = spark.range(0, 200_000, 50).select(F.col("id").cast("string").cast("binary").alias("piece"))
    kept = {r["id"] for r in CT.known_grams(grams, pieces, 1000).collect()}
    assert kept >= set(range(0, 200_000, 50)) and len(kept) < 4000 + 4000
    assert CT.known_grams(grams, pieces.limit(0), 1).count() == 0


def test_spans_of_any_needle(spark):
    rows = [("a.b a.b c", "a.b"), ("plain", ""), ("x\\Ey\\E", "\\E"), ("éé", "é"), (None, "q"), ("none", "q"), ("", "q")]
    df = spark.createDataFrame(rows, "text string, needle string")

    def want(text, needle):
        if text is None:
            return None
        if needle == "":
            return [(text, None)]
        out = []
        for i, part in enumerate(text.split(needle)):
            out += ([(needle, "0")] if i else []) + ([(part, None)] if part else [])
        return out

    for text, needle, spans in df.select("text", "needle", RT.highlight_spans(F.col("text"), F.col("needle"))).collect():
        assert (spans if spans is None else [tuple(s) for s in spans]) == want(text, needle)
    for text, needle in rows:
        one = df.filter(F.col("text").eqNullSafe(F.lit(text))).limit(1)
        spans = one.select(RT.highlight_spans(F.col("text"), needle)).first()[0]
        assert (spans if spans is None else [tuple(s) for s in spans]) == want(text, needle)


def test_hits_carry_spans(spark):
    c = Corpus.from_shards(spark, [["the cat", "a the"], ["cat the cat"]])
    idx = spark.read.parquet(SX.build_index(c.layout, scratch_path(spark, "spans-idx")))
    hits = RT.search(idx, c.layout, "the", 5, 3).collect()
    assert len(hits) == 3 and all("".join(s["fragment"] for s in h["spans"]) == h["text"] for h in hits)
    assert all([s["fragment"] for s in h["spans"] if s["label"] == "0"] == ["the"] for h in hits)
    req = spark.createDataFrame([(1, 0, hits[0]["rank"], 3, 3, "the")],
                                "req_id long, s int, rank long, needle_len int, max_ctx_len int, query string")
    got = RT.get_doc_by_rank(idx, c.layout, req).collect()
    assert len(got) == 1 and "".join(s["fragment"] for s in got[0]["spans"]) == got[0]["text"]
