import json
import os
import tempfile

import pytest

from bytegram import Corpus
from bytegram.streaming.ingest import ingest_stream


def test_incremental_ingest_new_files_become_shards(spark):
    src = tempfile.mkdtemp(prefix="bytegram-stream-src-")
    out = tempfile.mkdtemp(prefix="bytegram-stream-out-") + "/corpus"
    ck = tempfile.mkdtemp(prefix="bytegram-stream-ck-")
    with open(f"{src}/a.jsonl", "w") as f:
        f.write("".join(json.dumps({"text": f"alpha {i}"}) + "\n" for i in range(5)))
    q = ingest_stream(spark, src, out, ck)
    q.awaitTermination()
    with open(f"{src}/b.jsonl", "w") as f:
        f.write("".join(json.dumps({"text": f"beta {i}", "n": i}) + "\n" for i in range(3)))
    q = ingest_stream(spark, src, out, ck)   # resumes: only b.jsonl is new
    q.awaitTermination()
    c = Corpus.open(spark, out)
    rows = [(r["shard"], r["doc_ix"], r["text"]) for r in c.layout.orderBy("doc_ix").collect()]
    assert [t for _, _, t in rows] == [f"alpha {i}" for i in range(5)] + [f"beta {i}" for i in range(3)]
    assert [d for _, d, _ in rows] == list(range(8))
    assert len({s for s, _, _ in rows}) == 2
    assert c.count("beta").first()["count"] == 3
    assert os.path.isdir(ck)


def test_parquet_sources_are_not_left_out_in_silence(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.jsonl").write_text(json.dumps({"text": "alpha"}) + "\n")
    spark.createDataFrame([("beta",)], "text string").write.parquet(str(src / "b.parquet"))
    with pytest.raises(ValueError, match="b.parquet"):
        ingest_stream(spark, str(src), str(tmp_path / "corpus"), str(tmp_path / "ck"))
    assert not (tmp_path / "corpus").exists()
