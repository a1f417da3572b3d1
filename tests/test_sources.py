"""File sources: JSON-lines edge cases and Parquet, written to a temporary folder."""
import gzip
import json
import os
import tempfile

import pytest
import zstandard

from bytegram import Corpus
from bytegram.sources import records as RC


def _dir():
    return tempfile.mkdtemp(prefix="bytegram-src-")


def test_jsonl_edge_cases(spark):
    d = _dir()
    os.makedirs(f"{d}/sub ü")
    with open(f"{d}/a.jsonl", "w", newline="") as f:
        f.write('{"text":"one","k":1}\n{"text":"two","k":null}\r{"text":"three","k":{"x":[1,2]}}')  # no final newline
    with gzip.open(f"{d}/sub ü/b.json.gz", "wt") as f:
        f.write('{"text":"é","k":2}\n')
    with open(f"{d}/c.zst", "wb") as f:
        f.write(zstandard.ZstdCompressor().compress(b'{"text":"z1"}\n{"text":"z2"}\n'))
    with open(f"{d}/skip.json", "w") as f:
        f.write('{"text":"no"}\n')
    with open(f"{d}/skip.txt", "w") as f:
        f.write("no\n")
    recs = RC.read_records(spark, d)
    rows = sorted((r["path"], r["linenum"], r["text"], r["fields"]) for r in recs.collect())
    assert rows == [
        ("a.jsonl", 0, "one", '{"k":1}'), ("a.jsonl", 1, "two", '{"k":null}'),
        ("a.jsonl", 2, "three", '{"k":{"x":[1,2]}}'),
        ("c.zst", 0, "z1", "{}"), ("c.zst", 1, "z2", "{}"),
        ("sub ü/b.json.gz", 0, "é", '{"k":2}')]
    c = Corpus.from_files(spark, d)
    docs = [(r["doc_ix"], r["text"]) for r in c.docs.orderBy("doc_ix").collect()]
    assert docs == [(0, "one"), (1, "two"), (2, "three"), (3, "z1"), (4, "z2"), (5, "é")]
    meta = json.loads(c.docs.filter("doc_ix = 1").first()["metadata"])
    assert meta == {"path": "a.jsonl", "linenum": 1, "metadata": {"k": None}}


def test_bad_records_fail_or_drop(spark):
    d = _dir()
    with open(f"{d}/a.jsonl", "w") as f:
        f.write('{"text":"ok"}\n\n{"other":1}\n{"text":"ok2"}\n')
    with pytest.raises(Exception):
        RC.read_records(spark, d).collect()
    kept = [r["text"] for r in RC.read_records(spark, d, on_bad="drop").orderBy("linenum").collect()]
    assert kept == ["ok", "ok2"]


def test_line_numbers_absolute_across_splits(spark):
    d = _dir()
    with open(f"{d}/big.jsonl", "w") as f:
        for i in range(3000):
            f.write(json.dumps({"text": f"line {i} " + "x" * (i % 50), "i": i}) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        recs = RC.read_records(spark, d)
        assert recs.rdd.getNumPartitions() > 4
        got = recs.select("linenum", "fields").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(json.loads(r["fields"])["i"] == r["linenum"] for r in got)
    assert len(got) == 3000


def test_parquet_and_text_key(spark):
    d = _dir()
    spark.createDataFrame([(1, "x", "é"), (2, "y", None)], "id long, body string, tag string") \
        .coalesce(1).write.parquet(f"{d}/p.parquet")
    c = Corpus.from_files(spark, d, text_key="body")
    rows = c.docs.orderBy("doc_ix").collect()
    assert [r["text"] for r in rows] == ["x", "y"]
    assert json.loads(rows[1]["metadata"])["metadata"] == {"id": 2, "tag": None}


def test_resume_pending_sources(spark):
    d = _dir()
    for n in ("a", "b", "c"):
        with open(f"{d}/{n}.jsonl", "w") as f:
            f.write('{"text":"t"}\n')
    lst = RC.list_sources(spark, d)
    manifest = lst.filter(lst.path.endswith("/a.jsonl"))
    pending = sorted(r["path"].rsplit("/", 1)[1] for r in RC.pending_sources(lst, manifest).collect())
    assert pending == ["b.jsonl", "c.jsonl"]


def test_write_and_open_round_trip(spark):
    d = _dir()
    with open(f"{d}/a.jsonl", "w") as f:
        for i in range(50):
            f.write(json.dumps({"text": "doc %d " % i * (i % 7 + 1)}) + "\n")
    c = Corpus.from_files(spark, d, num_shards=3)
    out = f"{d}-corpus"
    c.write(out)
    o = Corpus.open(spark, out)
    a = sorted(tuple(r) for r in c.layout.select("doc_ix", "shard", "data_offset").collect())
    b = sorted(tuple(r) for r in o.layout.select("doc_ix", "shard", "data_offset").collect())
    assert a == b
    with pytest.raises(ValueError):
        Corpus.open(spark, f"{d}/a.jsonl".replace("a.jsonl", ""))
