"""Batch counts without a row for each place and length, against plain Python and against the join of grams."""
import random

import pytest

from bytegram import Corpus
from bytegram.operators import count as CT
from bytegram.operators import positions as PS

from . import brute


@pytest.mark.parametrize("seed_bytes", [3, 8])
def test_places_make_no_rows(spark, monkeypatch, seed_bytes):
    monkeypatch.setattr(CT, "STRETCH_BYTES", 3000)
    draw = random.Random(8)
    texts = ["".join(draw.choices("ab é\x00", k=draw.randrange(60))) for _ in range(150)] + ["", "a", "ab" * 500, "abababab\x00", "x" * 70_000 + "end"]
    queries = ["a", "b", "é", "ab", "ba ", "a\x00", "\x00", "aba", "abababa", "abababab", "abababab\x00", "ababababa", "ab" * 12, "ab" * 500, "x" * 9, "xend",
               "xxxxxxxend", "end", "zz", "zzzzzzzzzz", "b é" * 3, texts[3], texts[5], "é" * 4, "a" * 8 + "b"]
    queries = [q for q in dict.fromkeys(queries) if q]
    docs = Corpus.from_shards(spark, [texts]).texts
    q = spark.createDataFrame([*enumerate(queries), (None, "a")], "qid long, query string")
    got = CT.count_batch(docs, q, seed_bytes=seed_bytes)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "substring(cb" not in plan
    want = {(i, s): sum(brute.overlap_count(t, s) for t in texts) for i, s in enumerate(queries)}
    assert {(r["qid"], r["query"]): r["count"] for r in got.collect()} == want | {(None, "a"): 0}
    monkeypatch.setattr(CT, "LOOKED_FOR", 0)
    assert sorted(map(str, CT.count_batch(docs, q, seed_bytes=seed_bytes).collect())) == sorted(map(str, got.collect()))


def test_long_documents_are_many_tasks(spark):
    docs = Corpus.from_shards(spark, [["x" * (1 << 20)] * 3]).texts
    found = PS.chunks(docs, overlap=3)
    sizes = [n for n in found.rdd.glom().map(len).collect() if n]
    assert len(sizes) > 2 and sum(sizes) == 48
