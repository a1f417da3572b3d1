"""Random corpora over a small alphabet (1- to 4-byte characters) against naive Python."""
import random

import pytest

from bytegram import Corpus
from bytegram.operators import count as CT
from bytegram.operators import find as FD
from bytegram.operators import suffix as SX

from . import brute

ALPHABET = ["a", "b", "é", "😀"]


def random_corpus(rng):
    shards = []
    for _ in range(rng.randint(1, 3)):
        docs = []
        for _ in range(rng.randint(1, 5)):
            if docs and rng.random() < 0.3:
                docs.append(docs[-1])            # exact copies
            else:
                docs.append("".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 12))))
        shards.append(docs)
    return shards


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_corpora(spark, seed):
    rng = random.Random(seed)
    shards = random_corpus(rng)
    c = Corpus.from_shards(spark, shards)
    lay = c.layout.checkpoint()
    idx = SX.exact_ranks(SX.suffix_rows(lay, k=3)).checkpoint()
    # exact ranks = brute-force suffix array, per shard
    got = {}
    for r in idx.select("shard", "ptr", "rank").collect():
        got.setdefault(r["shard"], {})[r["ptr"]] = r["rank"]
    for s, texts in enumerate(shards):
        sa = brute.suffix_array(brute.shard_bytes(texts))
        assert [got[s][p] for p in sa] == list(range(len(sa)))
    queries = ["a", "ab", "aa", "é", "😀a", "bé", "zz"] + ["".join(rng.choice(ALPHABET) for _ in range(4))]
    for q in queries:
        want_count = sum(brute.overlap_count(t, q) for texts in shards for t in texts)
        assert c.count(q).first()["count"] == want_count, q
        want = [brute.find(texts, q) for texts in shards]
        scan = [(r["lo"], r["hi"]) for r in FD.find_scan(lay, q).orderBy("shard").collect()]
        assert scan == want, q
        ind = [(r["lo"], r["hi"]) for r in SX.find_indexed(idx, lay, q, k=3).orderBy("shard").collect()]
        assert ind == want, q
    qdf = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "qid long, query string")
    batch = {r["qid"]: r["count"] for r in CT.count_batch(c.docs, qdf, seed_bytes=2).collect()}
    for i, q in enumerate(queries):
        assert batch[i] == sum(brute.overlap_count(t, q) for texts in shards for t in texts), q
