"""No table that grows with the input is broadcast, though Spark takes it for small: it sizes exploded rows as if there were one."""
from __future__ import annotations

from pyspark.sql import functions as F

from bytegram.llm import components, simhash, suffix_dedup
from bytegram.llm.common import written


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_variants_of_fingerprints_are_not_broadcast(spark):
    prints = written(spark.range(5000).select(F.xxhash64("id").alias("fp")), "prints")
    found = simhash.links(prints)
    assert "SortMergeJoin" in _plan(found) and "Broadcast" not in _plan(found)
    near = written(spark.createDataFrame([(0,), (7,), (1 << 40,)], "fp long"), "prints")
    assert {tuple(r) for r in simhash.links(near).collect()} == {(0, 7), (0, 1 << 40), (7, 1 << 40)}


def test_links_are_not_broadcast(spark):
    edges = written(spark.createDataFrame([(2, 1), (3, 2), (9, 8)], "a long, b long"), "edges")
    assert "Broadcast" not in _plan(components._lowest(edges))
    assert {tuple(r) for r in components.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}


def test_fingerprinted_rows_meet_their_groups_without_a_broadcast(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i % 3}") for i in range(30)] + [(None, None)], "doc_id long, text string")
    out = simhash.near_duplicates(docs)
    assert "Broadcast" not in _plan(out) and out.count() == 31


def test_shared_strings_are_not_broadcast(spark):
    shape = "id long, hash long, text binary, found " + suffix_dedup._FOUND
    run = {"name": 1, "w": 5, "low": 0, "span": 3, "alone": False}
    texts = written(spark.createDataFrame([(1, 1, b"x", [run]), (2, 2, b"x", [run, run | {"w": 6}]), (3, 3, None, None)], shape), "texts")
    out = suffix_dedup._shared(texts)
    assert "Broadcast" not in _plan(out)
    assert sorted(r["id"] for r in out.collect()) == [1, 2]
