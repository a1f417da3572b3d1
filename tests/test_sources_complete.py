"""Listings lose no file, Parquet files may differ in columns, and edge cases of counting, search and marked text."""
import os
import textwrap

import pytest
from pyspark.sql import functions as F

from bytegram.operators import retrieve as RT
from bytegram.operators import suffix as SX
from bytegram.plans.corpus import Corpus
from bytegram.sources import records as RC


def _write(path, text='{"text": "x"}\n'):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_listing_is_complete(spark, tmp_path):
    root = str(tmp_path)
    names = ["v.jsonl", "a/b/w.jsonl", ".sub/z.jsonl", "_x.jsonl", ".y.jsonl"]
    for n in [*names, "skip.txt"]:
        _write(f"{root}/{n}")

    def listed(entry):
        return {r["path"].split(root + "/")[1] for r in RC.list_sources(spark, entry).collect()}

    assert listed(root) == set(names)
    # patterns pass over names that begin with a dot, as globs do
    assert listed(f"{root}/**/*.jsonl") == {"v.jsonl", "a/b/w.jsonl", "_x.jsonl"}
    assert listed(f"{root}/*.jsonl") == {"v.jsonl", "_x.jsonl"}
    assert listed([f"{root}/a/*/w.jsonl", f"{root}/v.jsonl"]) == {"a/b/w.jsonl", "v.jsonl"}
    with pytest.raises(FileNotFoundError):
        RC.list_sources(spark, f"{root}/[!v].jsonl")
    with pytest.raises(FileNotFoundError):
        RC.list_sources(spark, f"{root}/nothing")
    with pytest.raises(ValueError, match="rename"):
        RC.read_records(spark, root)


def test_parquet_records_have_the_columns_of_their_file(spark, tmp_path):
    for name, col in (("a", "a"), ("b", "b")):
        spark.createDataFrame([(f"text {name}", 7)], f"text string, {col} int").coalesce(1).write.parquet(f"{tmp_path}/{name}.dir")
    got = {r["text"]: r["fields"] for r in RC.read_records(spark, str(tmp_path)).collect()}
    assert got == {"text a": '{"a":7}', "text b": '{"b":7}'}


def test_empty_query_by_shard_and_negative_limits(spark, tmp_path):
    c = Corpus.from_shards(spark, [["ab", "ab", "aba"], ["ab", "b"]])
    assert {r["shard"]: r["count"] for r in c.count_by_shard("").collect()} == {0: 11, 1: 6}
    index = spark.read.parquet(SX.build_index(c.layout, str(tmp_path / "index"), ranked=True))
    assert RT.search(index, c.layout, "ab", max_results=-1).count() == 0


def test_search_of_any_length(spark, tmp_path):
    long = "long passage of more than thirty-two bytes, é"
    c = Corpus.from_shards(spark, [[f"b {long} x", f"{long} a", long[:-1]], [f"{long}{long}", "none"]])
    index = spark.read.parquet(SX.build_index(c.layout, str(tmp_path / "index"), ranked=True))
    hits = RT.search(index, c.layout, long, max_results=10, max_ctx_len=3).orderBy("hit").collect()
    assert [h["shard"] for h in hits] == [0, 1, 0, 1] and {h["doc_ix"] for h in hits} == {0, 1, 3}
    assert all(long in h["text"] for h in hits)
    ranks = [(h["shard"], h["rank"]) for h in hits]
    by_shard = {s: [r for t, r in ranks if t == s] for s in (0, 1)}
    assert all(v == list(range(v[0], v[0] + 2)) for v in by_shard.values())


def test_marked_text_equals_python(spark):
    texts = ["  a na\r\n\r\n b\x0bna c \x85", "na", "", " \n ", "x\rna\n\n  y　", " na\x1d\x1e z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["k"] for r in df.select("i", RT.kwic_text(F.col("t"), "na").alias("k")).collect()}
    assert got == {i: textwrap.indent(t.replace("na", ">>>na<<<").strip(), "    ") for i, t in enumerate(texts)}
