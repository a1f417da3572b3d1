"""Cross-path checks: per-shard sums equal totals, and answers do not depend on the partition count."""
from bytegram import Corpus
from bytegram.operators import find as FD

SF = "/root/testdata/sf0.001"
QS = ["the", "é", "anan", "zqzq", ""]


def _answers(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        c = Corpus.from_parquet(spark, f"{SF}/documents.parquet", num_shards=3)
        lay = c.layout
        intervals = sorted(tuple(r) for r in FD.find_scan_many(lay, QS).collect())
        counts = {q: c.count(q).first()["count"] for q in QS}
        per_shard = {q: sum(r["count"] for r in c.count_by_shard(q).collect()) for q in QS if q}
        offsets = sorted(tuple(r) for r in lay.select("doc_ix", "shard", "data_offset").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    return intervals, counts, per_shard, offsets


def test_independent_of_partitions_and_consistent(spark):
    a = _answers(spark, 3)
    b = _answers(spark, 11)
    assert a == b
    intervals, counts, per_shard, _ = a
    for q in QS:
        total = sum(hi - lo for qq, _, lo, hi in intervals if qq == q)
        assert total == counts[q], q
        if q:
            assert per_shard[q] == counts[q], q
