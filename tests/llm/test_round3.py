"""Merkle manifest, source mix and spelling variants against plain Python: nulls, ties, repeats, empty tables, extra columns."""
from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytegram.llm import merkle, mixing, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos long, size long, tree long, n long, word string"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _docs(spark, rows):
    """Rows with extra columns whose names clash with names inside the operators."""
    return spark.createDataFrame([(*r, 7, 7, 7, 7, "x") for r in rows], DOCS).repartition(5)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(700):
        lang = rng.choice([None, "de", "en", "en", "en", "en", "éé"])
        text = rng.choice([None, "", "Plain", "LONG " * 3000, "ÀÉ mixed Case é\n", f"Text {i}"])
        out.append((i if i % 50 else None, text, lang, rng.choice([None, "", "web", "böok"]), rng.choice([None, 5])))
    return [*out, out[7], out[7], *[(9999, "Same", "en", "web", 4)] * 30, (5, "one", "lone", None, 3)]


def _lower(text):
    return None if text is None else text.translate(str.maketrans(UPPER, UPPER.lower()))


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, text, lang, source, n_chars):
    coded = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return _h(*coded)


def _plain_manifest(rows):
    """Trees as nested lists; the proof of a leaf is found by walking down."""
    groups = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        leaf = _leaf(*r)
        now = _leaf(r[0], _lower(r[1]), *r[2:]) if hit else leaf
        groups[r[2]].append((r[0], leaf, now))

    def climb(hashes, at, now):
        """Sibling text and root when the node at ``at`` is replaced by ``now``."""
        proof = ""
        while len(hashes) > 1:
            run = hashes[at // 8 * 8:at // 8 * 8 + 8]
            proof += "".join(run[:at % 8] + run[at % 8 + 1:])
            now = _h(*run[:at % 8], now, *run[at % 8 + 1:])
            hashes = [_h(*hashes[i:i + 8]) for i in range(0, len(hashes), 8)]
            at //= 8
        return proof, hashes[0], now

    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subroots = [climb([x[1] for x in groups[g]], 0, "")[1] for g in order]
    out = []
    for k, g in enumerate(order):
        hashes = [x[1] for x in groups[g]]
        for i, (doc_id, leaf, now) in enumerate(groups[g]):
            proof, subroot, now = climb(hashes, i, now)
            more, root, now = climb(subroots, k, now)
            out.append((doc_id, leaf, subroot, root, _h(proof + more), now, now == root))
    return Counter(out)


def _manifest(df):
    return Counter(tuple(r) for r in merkle.manifest(df).collect())


def test_manifest_equals_plain_trees(spark, rows):
    got = _manifest(_docs(spark, rows))
    assert got == _plain_manifest(rows)
    assert {k[-1] for k in got} == {True, False}


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (8, ["en"]), (65, [None]), (30, [str(i) for i in range(30)])])
def test_manifest_of_few_rows_or_many_groups(spark, n, langs):
    rows = [(i, f"T{i}", langs[i % len(langs)], "s", 2) for i in range(n)]
    assert _manifest(_docs(spark, rows)) == _plain_manifest(rows)


def test_manifest_of_nothing_and_a_changed_byte(spark):
    assert merkle.manifest(_docs(spark, []).limit(0)).count() == 0
    rows = [(i, "same", "en", "s", 4) for i in range(20)]
    roots = {merkle.manifest(_docs(spark, r)).first()["root"] for r in (rows, [*rows[:13], (13, "sameX", "en", "s", 4), *rows[14:]])}
    assert len(roots) == 2


def test_node_rows_link_every_child_to_its_parent(spark, rows):
    starts, nodes = merkle.build(merkle.leaves(_docs(spark, rows).select("doc_id", "source", "lang", "n_chars", "text"),
                                               ("doc_id", "source", "lang", "n_chars", "text"), "doc_id", "lang",
                                               F.col("text"), "text"))
    kids = nodes.alias("k").join(nodes.alias("p"), F.expr("p.tree = k.up_tree and p.level = k.up_level and p.pos = k.up_pos"))
    wrong = kids.filter("substring(p.run, 32 * k.slot + 1, 32) <> k.hash").count()
    assert wrong == 0 and nodes.filter("up_tree IS NULL").count() == 1 and kids.count() == nodes.count() - 1


def _plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    whole, full = sum(sizes.values()), set()
    while True:
        rest = whole - most * sum(sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * rest > most * sizes[s] * open_weight}
        if not more:
            return {s: most * sizes[s] if s in full else weight[s] * rest / open_weight for s in order}
        full |= more


@pytest.fixture(scope="module")
def mix_rows():
    rng = random.Random(3)
    rows = []
    for i in range(900):
        source = rng.choice([None, "a", "b", "é", "z", "hot", "hot", "hot", "tiny"] if i > 10 else ["few", "nil"])
        n = 0 if source == "nil" else rng.choice([1, 3, 40, 200])
        rows.append((i if i % 40 else None, " ".join(["wörd"] * n) or rng.choice([None, "", " \n\t"]), "en", source, 1))
    return rows + [(77777, "again " * 60, "en", "hot", 1)] * 300


def test_mix_reaches_its_targets_with_whole_documents(spark, mix_rows):
    got = mixing.copies(_docs(spark, mix_rows)).collect()
    words = Counter()
    for r in mix_rows:
        words[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    plain = _plain_targets(words)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len((r[1] or "").split())) for r in mix_rows)
    taken, longest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == words[r["source"]] and r["target"] == pytest.approx(plain[r["source"]])
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["copies"] in (int(rate), int(rate) + 1) and r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s, t in plain.items():
        assert abs(taken[s] - t) <= 2 * longest[s], s


def test_mix_reruns_agree_and_a_seed_changes_the_draws(spark, mix_rows):
    def draws(order, **options):
        return Counter(tuple(r) for r in mixing.copies(_docs(spark, order), **options).select("doc_id", "size", "copies").collect())

    turned = random.Random(1).sample(mix_rows, len(mix_rows))
    assert draws(mix_rows) == draws(turned) != draws(mix_rows, seed="other")


def test_mix_draws_come_out_with_the_fraction_as_probability(spark):
    rows = [(i, "w " * (1 + i % 7), "en", s, 1) for s in "abc" for i in range(40)]
    hits = Counter()
    for k in range(8):
        for r in mixing.copies(_docs(spark, rows), seed=f"s{k}").collect():
            hits[r["source"], r["doc_id"]] += r["copies"] - int(r["target"] / r["source_size"])
            fraction = r["target"] / r["source_size"] % 1
    spread = np.array([hits["a", i] for i in range(40)]) / 8  # rate of a: 0.5
    assert abs(spread.mean() - 0.5) < 0.05 and spread.std() < 0.3 and 0 <= fraction < 1


def test_mixed_rows_and_an_empty_table(spark, mix_rows):
    docs = _docs(spark, mix_rows)
    want = mixing.copies(docs).groupBy("source").agg(F.sum("copies").alias("n")).filter("n > 0")
    got = mixing.mixed(docs).groupBy("source").count()
    assert sorted(map(str, want.collect())) == [str(r).replace("count", "n") for r in sorted(got.collect(), key=str)]
    assert mixing.copies(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.copies(_docs(spark, [(1, None, None, None, None)])).first()["copies"] == 0


def _plain_variants(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = _lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 3}
    letters = [chr(c) for c in [*range(0x61, 0x7B), *range(0xC0, 0x100)]]

    def near(w):
        made = {w[:i] + w[i + 1:] for i in range(len(w))}
        made |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        made |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        return [x for x in made if x != w and x in counts]

    form, links = {}, {w: near(w) for w in counts}
    for w, others in links.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(links[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def word_rows():
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdeéßÿ÷", k=rng.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aabaa", "q" * 45, "q" * 46, "q" * 300]
    rows = []
    for i in range(250):
        words = []
        for _ in range(80):
            w = rng.choice(base[:20] if rng.random() < .7 else base)
            if rng.random() < .25 and len(w) < 60:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abé") + w[k + 1:], w[:k] + rng.choice("aß") + w[k:]])
            words.append(rng.choice([w, w.capitalize(), w + "1"]))
        rows.append((i if i % 30 else None, rng.choice([" ", "-", "\n", "_"]).join(words), "en", "s", 1))
    return rows + [rows[3]] * 5 + [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, "Q" * 300 + " " + "q" * 301, "en", "s", 1)] * 3


def test_variants_equal_all_edits_tried(spark, word_rows):
    got = {tuple(r) for r in spelling.variants(_docs(spark, word_rows)).collect()}
    want = _plain_variants(word_rows)
    assert got == want
    assert any(x[1] and x[2] != x[1] for x in want), "a chain of forms"


def test_a_filter_that_is_too_small_changes_nothing(spark, word_rows):
    got = {tuple(r) for r in spelling.variants(_docs(spark, word_rows), max_bytes=64).collect()}
    assert got == _plain_variants(word_rows)


def test_filters_pass_few_strings_that_are_no_words(spark):
    rng = random.Random(9)
    words = list({"".join(rng.choices("abcdefgh", k=7)) for _ in range(4000)})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    tables = spark.sparkContext.broadcast(spelling.filters(df, spelling.shard_blocks(df)))
    found = spelling.candidates(df, tables).select("other").collect()
    false = [r[0] for r in found if r[0] not in set(words)]
    assert len(false) < 0.02 * 4000 * 7 * 90 / 2 and sum(len(t) for t in tables.value.values()) * 64 <= 2 * spelling.BITS * 4000


def test_variants_of_nothing(spark):
    empty = _docs(spark, []).limit(0)
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(_docs(spark, [(1, None, None, None, None), (2, "", None, None, None)])).count() == 0
