"""Listing against ``glob`` and ``os.walk``, records against ``json``, resumed ingest, named corpora."""
import glob
import gzip
import itertools
import json
import os
import random

import pytest

from bytegram.constants import SOURCE_SUFFIXES
from bytegram.operators import ordered as OD
from bytegram.plans import ingest as IN
from bytegram.plans.catalog import Catalog
from bytegram.plans.corpus import Corpus
from bytegram.sources import discovery as DI
from bytegram.sources import records as RC


def _write(path, text='{"text": "x"}\n'):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def _plain(entries):
    """The files that globbing and walking find; a set, as each is listed once."""
    found = set()
    for entry in entries:
        matches = glob.glob(entry.rstrip("/"), recursive=True) or [entry.rstrip("/")]
        for m in matches:
            if not os.path.exists(m):
                raise FileNotFoundError(m)
            names = [m] if os.path.isfile(m) else [os.path.join(d, f) for d, _, fs in os.walk(m) for f in fs]
            found |= {os.path.normpath(n) for n in names if n.endswith(SOURCE_SUFFIXES)}
    return found


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree"))
    for name in ("abc/w.jsonl", "ax.jsonl", "a1/b/c/d.zst", "a1/.h/x.jsonl", "a1/_u.json.gz", ".hid/y.jsonl", ".z.jsonl", "b/n.txt",
                 "b/p.parquet", "b/q.zstd", "[ab]/e.jsonl", "c d/é+%.jsonl", "a1/b/.k.jsonl"):
        _write(f"{root}/{name}")
    os.makedirs(f"{root}/empty")
    os.symlink(f"{root}/abc", f"{root}/b/link")
    return root


PATTERNS = ["", "a*", "**", "**/*.jsonl", "[!a]*", ".*", "a1/**/d.zst", "empty", "**/b/*", "b/n.txt", "[ab]", "c d/*", "**/.k*", "b/link"]


def test_listing_equals_glob_and_walk(spark, tree):
    for p in PATTERNS:
        got = {r["path"].removeprefix("file:") for r in RC.list_sources(spark, f"{tree}/{p}").collect()}
        assert got == _plain([f"{tree}/{p}"]), p


def test_stores_beyond_python_are_listed_alike(spark, tree, monkeypatch):
    monkeypatch.setattr(DI, "in_tasks", lambda store: False)
    for p in ("a*", "**/*.jsonl", "empty", "b/q*"):
        got = {r["path"].removeprefix("file:") for r in RC.list_sources(spark, f"{tree}/{p}").collect()}
        assert got == _plain([f"{tree}/{p}"]), p
    with pytest.raises(FileNotFoundError):
        RC.list_sources(spark, f"{tree}/nothing*")


def test_listing_of_several_entries(spark, tree):
    entries = [f"{tree}/a*", f"{tree}/b/", f"{tree}/abc/w.jsonl"]
    assert {r["path"].removeprefix("file:") for r in RC.list_sources(spark, entries).collect()} == _plain(entries)
    for wrong in ("nothing", "x*", "a1/none/*"):
        with pytest.raises(FileNotFoundError):
            RC.list_sources(spark, [f"{tree}/b", f"{tree}/{wrong}"])


LINES = ['{"text":"a","x":1.0,"y":1e400,"z":12345678901234567890123456789012345678901234567890}',
         '{"text":"a","k":1,"k":2,"s":"1","t":" q\\" \\u00e9\\n","n":null,"b":true}',
         '{"a":{"x": [1.0, 1e400,"z"], "x":2},"text":"first","text":"last \\ud83d\\ude00"}',
         '{"text":"t","n":NaN,"i":-Infinity,"neg":-0.0,"e":1E5,"small":1e-400,"half":"\\ud83d"}', '  {"text":"" , "o" : { } , "l":[ ] }  ']
BAD = ["", "null", "[1]", '{"text":5}', '{"text":null}', '{"a":1}', "{bad", '{"text":"x"} more', "{'text':'x'}", '{"text":"half \\ud83d"}', "[" * 5000]


def test_fields_are_those_that_json_reads(spark, tmp_path):
    _write(f"{tmp_path}/a.jsonl", "\n".join(itertools.chain(*zip(LINES, itertools.cycle(BAD)))))
    _write(f"{tmp_path}/b.jsonl", "\n".join(BAD))
    got = {r["linenum"]: r for r in RC.read_records(spark, str(tmp_path), on_bad="drop").filter("path = 'a.jsonl'").collect()}
    assert sorted(got) == [2 * i for i in range(len(LINES))]
    for i, line in enumerate(LINES):
        want = json.loads(line)
        assert got[2 * i]["text"] == want.pop("text")
        assert repr(json.loads(got[2 * i]["fields"])) == repr(want)
    assert RC.read_records(spark, f"{tmp_path}/b.jsonl", on_bad="drop").count() == 0
    with pytest.raises(Exception, match="record without text"):
        RC.read_records(spark, f"{tmp_path}/b.jsonl").collect()


def test_compressed_and_small_files_are_read_once(spark, tmp_path):
    with gzip.open(f"{tmp_path}/a.json.gz", "wt") as f:
        f.writelines(json.dumps({"text": str(i), "i": i}) + "\n" for i in range(500))
    _write(f"{tmp_path}/b.jsonl")
    recs = RC.read_records(spark, str(tmp_path))
    plan = recs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan text") == 1 and "Join" not in plan
    assert all(json.loads(r["fields"]).get("i", 0) == r["linenum"] for r in recs.collect())


def test_parquet_records_keep_their_own_columns(spark, tmp_path):
    spark.createDataFrame([("t0", 7, None)], "text string, a int, b string").coalesce(1).write.parquet(f"{tmp_path}/x")
    spark.createDataFrame([("t1", "seven")], "text string, a string").coalesce(1).write.parquet(f"{tmp_path}/y")
    spark.createDataFrame([("t2", [1, 2])], "text string, c array<int>").coalesce(1).write.parquet(f"{tmp_path}/z")
    listing = RC.list_sources(spark, str(tmp_path))
    got = {r["text"]: r["fields"] for r in RC.read_listing(spark, listing, RC.common_root(listing)).collect()}
    assert got == {"t0": '{"a":7,"b":null}', "t1": '{"a":"seven"}', "t2": '{"c":[1,2]}'}
    assert sorted(r["records"] for r in RC.source_counts(spark, listing).collect()) == [1, 1, 1]
    one = listing.filter(listing.path.contains("/y/")).first()["path"]
    sliced = RC.read_slice(spark, listing, RC.common_root(listing), one.removeprefix(RC.common_root(listing)), 0)
    assert sliced.inputFiles() == [one.replace("file:/", "file:///")] and sliced.count() == 1


def _sources(root, n=9):
    for i in range(n):
        text = "".join(json.dumps({"text": f"file {i} line {k} " + "x" * (i * 7 % 11), "k": k}) + "\n" for k in range(i % 4 + 1))
        _write(f"{root}/{'sub/' * (i % 3)}{i}.jsonl", text)


def test_a_run_that_dies_is_resumed(spark, tmp_path, monkeypatch):
    src, path = f"{tmp_path}/src", f"{tmp_path}/corpus"
    _sources(src)
    spark.createDataFrame([("parquet text", 3)], "text string, k int").coalesce(1).write.parquet(f"{src}/zz")
    want = [(r["path"], r["linenum"], r["text"]) for r in RC.read_records(spark, src).orderBy("path", "linenum").collect()]

    real, writes = IN.LY.explicit_shards, []

    def dies(docs):
        writes.append(1)
        if len(writes) == 3:
            raise RuntimeError("executor lost")
        return real(docs)

    monkeypatch.setattr(IN.LY, "explicit_shards", dies)
    with pytest.raises(RuntimeError):
        list(IN.ingest(spark, src, path, bytes_per_shard=200))
    assert IN.done(spark, path).select("shard").distinct().count() == 2
    # the third shard was half written: a folder without log rows
    spark.read.parquet(f"{path}/shard=0").limit(1).write.parquet(f"{path}/shard=2")
    assert list(IN.ingest(spark, src, path, bytes_per_shard=200))[0] == 2
    assert list(IN.ingest(spark, src, path, bytes_per_shard=200)) == []
    docs = Corpus.open(spark, path).docs.orderBy("doc_ix").collect()
    assert [(r["path"], r["linenum"], r["text"]) for r in docs] == want and [r["doc_ix"] for r in docs] == list(range(len(want)))
    _write(f"{src}/new.jsonl", '{"text":"late"}\n')
    assert len(list(IN.ingest(spark, src, path, bytes_per_shard=200))) == 1
    assert Corpus.open(spark, path).docs.orderBy("doc_ix").collect()[-1]["text"] == "late"
    _write(f"{src}/new.jsonl", '{"text":"late"}\n{"text":"more"}\n')
    with pytest.raises(ValueError, match="new.jsonl"):
        list(IN.ingest(spark, src, path))


def test_catalog(spark, tmp_path):
    rng = random.Random(2)
    texts = [["".join(rng.choices("ab ", k=30)) for _ in range(4)] for _ in range(3)]
    for k, t in enumerate(texts):
        c = Corpus.from_shards(spark, [t])
        c.write(f"{tmp_path}/c{k}")
        OD.build_ordered(c.layout, f"{tmp_path}/i{k}")
    cat = Catalog(spark, f"{tmp_path}/catalog")
    assert cat.entries().count() == 0 and cat.summary().count() == 0
    cat.register("one", f"{tmp_path}/c0", index=f"{tmp_path}/i0", keep=True)
    cat.register("two", [f"{tmp_path}/c1", f"{tmp_path}/c2"])
    cat.register("gone", f"{tmp_path}/c1")
    cat.register("broken", f"{tmp_path}/nothing")
    cat.remove("gone")
    cat = Catalog(spark, f"{tmp_path}/catalog")  # another session sees the same names
    good, bad = cat.open_all()
    assert sorted(good) == ["one", "two"] and list(bad) == ["broken"]
    assert {r["corpus"]: r["docs"] for r in cat.summary().collect()} == {"one": 4, "two": 8}
    two = cat.open("two")
    rows = two.layout.orderBy("doc_ix").collect()
    assert [r["text"] for r in rows] == texts[1] + texts[2] and [r["shard"] for r in rows] == [0] * 4 + [1] * 4
    assert [r["doc_ix"] for r in rows] == list(range(8))
    assert cat.views("v_") == ["v_one", "v_two"] and spark.table("v_two").count() == 8
    s = cat.searchable("one")
    n = sum(t.encode().count(b"a") for t in texts[0])
    assert s.count("a").first()["count"] == n and s.search("a", 3).count() == min(3, n)
    assert s.get_doc_by_rank(0, 5, 1, 10).count() == 1
    for wrong in (lambda: s.get_doc_by_rank(1, 0, 1), lambda: s.get_doc_by_rank(0, -1, 1), lambda: s.get_doc_by_rank(0, 0, -1),
                  lambda: s.get_doc_by_rank(0, 0, 1, -1), lambda: s.search("a", 1, -1)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(TypeError):
        s.count(5)
    with pytest.raises(KeyError):
        cat.open("gone")
