"""Derived sources of many sorted parts, and Parquet folders of several files, give the records of one file."""
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bytegram.sources import derive as DV
from bytegram.sources import lines as LN
from bytegram.sources import records as RC


@pytest.mark.parametrize("fmt", ["jsonl", "gz", "zst"])
def test_one_file_of_many_parts_in_order(spark, tmp_path, monkeypatch, fmt):
    monkeypatch.setattr(DV, "part_count", lambda spark, size: 5)
    rows = [(i * 7 % 300, "a" if i % 3 else "b c/%", "é" * (i % 9)) for i in range(300)] + [(300, None, "n"), (301, "", "e")]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    path = DV.write_jsonl(spark, df, str(tmp_path / "s"), fmt, "source", "id", F.to_json(F.struct("text", "id", "source")))
    found = {}
    for r in RC.read_records(spark, path).collect():
        fields = json.loads(r["fields"])
        found.setdefault(r["path"], []).append((r["linenum"], fields["id"], r["text"], fields.get("source")))
    assert all(p.endswith("/docs" + DV.FORMATS[fmt][2]) for p in found)
    got = {}
    for mine in found.values():
        mine.sort()
        assert [x[0] for x in mine] == list(range(len(mine)))
        ids = [x[1] for x in mine if x[1] < 300]
        assert ids == sorted(ids)
        got |= {x[1]: (x[3] or None, x[2]) for x in mine}
    assert got == {i: (s or None, t) for i, s, t in rows}


def test_lines_run_on_over_the_files_of_a_folder(spark, tmp_path):
    df = spark.range(40).withColumn("text", F.concat(F.lit("t"), "id"))
    df.orderBy("id").repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "k0"))
    df.filter("id < 3").coalesce(1).write.parquet(str(tmp_path / "k1"))
    listing = RC.list_sources(spark, str(tmp_path))
    assert listing.count() > 3
    root = RC.common_root(listing)
    recs = RC.numbered_by_folder(RC.read_listing(spark, listing, root), RC.source_counts(spark, listing), root)
    got = {(r["path"].split("/")[0], r["linenum"]): r["text"] for r in recs.collect()}
    assert got == {("k0", i): f"t{i}" for i in range(40)} | {("k1", i): f"t{i}" for i in range(3)}


def test_few_lines_are_python_objects_at_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(LN, "_absolute", lambda rows, lines, cut, columns: rows)
    lines = spark.createDataFrame([], "_abs string, _blk long, value string")

    class Taken:
        def mapInArrow(self, fn, schema):
            whole = pa.RecordBatch.from_arrays([pa.array(["f"] * 1300), pa.array([0] * 1300, pa.int64()),
                                                pa.array(['{"text": "x", "i": %d}' % i for i in range(1300)])], names=["_abs", "_blk", "value"])
            seen.extend(fn(iter([whole])))
            return seen

    monkeypatch.setattr(LN, "located", lambda _: Taken())
    LN.records(lines, False, "text")
    assert max(b.num_rows for b in seen) <= 500
    assert [k for b in seen for k in b.column(2).to_pylist()] == list(range(1300))
    assert [f for b in seen for f in b.column(4).to_pylist()] == ['{"i":%d}' % i for i in range(1300)]
