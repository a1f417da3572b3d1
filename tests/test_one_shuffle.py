"""The corpus table is built with one shuffle of texts, whatever order documents come in."""
import random
import re

from pyspark.sql import functions as F

from bytegram.operators import layout as L
from bytegram.plans.corpus import Corpus

SCHEMA = "doc_ix long, path string, linenum long, text string, metadata string"


def _plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_texts_are_shuffled_once_and_lie_in_order(spark):
    rng = random.Random(1)
    texts = ["é" * rng.randrange(40) for _ in range(500)]
    rows = [(i, "mem", i, t, "{}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA).repartition(7)
    lay = L.assign_shards(docs, 3)
    got = lay.withColumn("_part", F.spark_partition_id()).orderBy("doc_ix").collect()
    assert [r["text"] for r in got] == texts
    begin, total = 0, sum(len(t.encode()) + 1 for t in texts)
    first = {}
    for r, t in zip(got, texts):
        shard = min(2, begin * 3 // total)
        first.setdefault(shard, begin)
        assert (r["shard"], r["data_offset"]) == (shard, begin - first[shard])
        begin += len(t.encode()) + 1
    parts = [r["_part"] for r in got]
    assert parts == sorted(parts) and len(set(parts)) > 1
    plan = _plan(lay)
    # no join moves texts
    assert not re.search(r"(SortMergeJoin|ShuffledHashJoin) \[doc_ix", plan)


def test_files_join_records_without_a_shuffle(spark):
    recs = spark.createDataFrame([("b", 0, "x"), ("a", 1, "y"), ("a", 0, "z")], "path string, linenum long, text string")
    out = L.global_doc_index(recs)
    assert {r["text"]: r["doc_ix"] for r in out.collect()} == {"z": 0, "y": 1, "x": 2}
    assert "BroadcastHashJoin [path" in _plan(out)


def test_a_built_layout_is_written_again(spark, tmp_path):
    c = Corpus.from_shards(spark, [["a", "é"], ["", "bc"]])
    lay = Corpus.open(spark, c.write(str(tmp_path / "c"))).layout.orderBy("doc_ix").collect()
    assert [(r["shard"], bytes(r["bytes"])) for r in lay] == [(0, b"a\xff"), (0, "é".encode() + b"\x00"), (1, b"\xff"), (1, b"bc\x00")]
