"""The pipeline's stages against brute force on what each was given."""
from __future__ import annotations

import numpy as np

import corpus_pipeline as cp
from bytegram.llm import simhash
from bytegram.llm.common import written
from tests.llm.test_operators import SF, _fingerprint, _removed


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = []
    for k, (_, stage) in enumerate(cp.STAGES):
        docs = written(stage(spark, docs, SF), f"stage-{k}")
        held.append(docs)
        if k < len(cp.STAGES) - 1:
            assert docs.columns == list(cp.COLUMNS)
    rules, groups, cut, clean, packed = held
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (rules, groups))
    prints = {k: np.uint64(_fingerprint(t, 4)) for k, t in before.items()}
    ids = sorted(prints)
    lead = {}
    for k in ids:  # smallest id first: spread it over all that it reaches
        if k in lead:
            continue
        todo = [k]
        while todo:
            a = todo.pop()
            if a not in lead:
                lead[a] = k
                todo += [b for b in ids if b not in lead and int(prints[a] ^ prints[b]).bit_count() <= 4]
    assert set(after) == set(lead.values())
    kept = {name: digest for name, _, _, _, digest in _removed([(k, t.encode()) for k, t in after.items()], 200)}
    import hashlib

    whole = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert set(whole) == set(after)
    exact = [k for k, t in whole.items() if hashlib.sha256(t.encode()).hexdigest() == kept[k]]
    assert len(exact) >= 0.9 * len(whole)  # the others lost a part of a character
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} <= set(whole)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in clean.collect()}


def test_stages_keep_rows_without_ids(spark):
    rows = [(None, f"word{i} " * 3 + " ".join(f"x{i}{j}" for j in range(40)), None, None, None) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES[1:4]:
        assert stage(spark, docs, SF).count() == 4, name
    assert simhash.near_duplicates(docs).count() == 4
