"""Licence scan against a plain recomputation, whole licence files, and the defined cases."""
import math
import random
import re

from bytegram.llm import licenses as L

FULL = {i: (name, text) for i, (name, text) in enumerate(L.TEMPLATES)}


def _plain(text, threshold=0.6):
    """Licence and score of a text by the definition, without any filter."""
    text = text or ""
    declared = re.search(L.SPDX, text)
    if declared:
        return declared.group(1), 1.0
    low = text.translate(str.maketrans(L.UPPER, L.LOWER))
    lines = low.split("\n")
    stop = next((i for i, x in enumerate(lines) if not re.search(L.COMMENT, x)), 0)
    units = [low, "\n".join(lines[:stop])] + re.split(L.BLANK_LINES, low) + lines
    words = [set(re.findall(L.TOKEN, t.translate(str.maketrans(L.UPPER, L.LOWER)))) for _, t in L.TEMPLATES]
    n = len(words)

    def idf(t):
        return math.log((1 + n) / (1 + sum(t in w for w in words))) + 1

    best = None
    for place, unit in enumerate(units):
        u = set(re.findall(L.TOKEN, unit))
        norm = math.sqrt(sum(idf(t) ** 2 for t in u))
        for (name, _), w in zip(L.TEMPLATES, words):
            if u:
                score = round(sum(idf(t) ** 2 for t in u & w) / norm / math.sqrt(sum(idf(t) ** 2 for t in w)), 6)
                if score >= threshold:
                    key = (1 if place < 2 else 2, -score, place, name)
                    best = min(best or key, key)
    return (best[3], -best[1]) if best else (None, None)


def _scan(spark, rows, **args):
    files = spark.createDataFrame([(*r, "clash", 0.5, 7) for r in rows],
                                  "doc_id long, path string, text string, license string, score double, place int")
    return {r["doc_id"]: r for r in L.scan_licenses(files, **args).collect()}


def _commented(text, mark="# "):
    words = text.split()
    return "\n".join(mark + " ".join(words[i:i + 9]) for i in range(0, len(words), 9))


def test_headers_and_licence_files_against_plain_formula(spark):
    rng = random.Random(5)
    filler = [f"w{i}" for i in range(300)] + sorted({w for _, t in L.TEMPLATES for w in re.findall(L.TOKEN, t.lower())})
    texts = ["", None, "\n\n\n", "Á " * 30, "license", "x" * 5000, "# a\n\n\n# b\nc", "word " * 3000]
    for _, text in L.TEMPLATES:
        texts += [text, "Copyright 2020 Some One\n\n" + text, _commented(text) + "\nimport os\n" + "x = 1\n" * 200,
                  "\n".join(rng.choices(filler, k=50)) + "\n\n" + "\n".join(text.split()) + "\n \n" + " ".join(rng.choices(filler, k=80)),
                  " ".join(rng.sample(text.split(), max(1, len(text.split()) * 2 // 3)))]
    texts += ["\n".join(" ".join(rng.choices(filler, k=rng.randint(1, 40))) for _ in range(rng.randint(1, 6))) for _ in range(150)]
    got = _scan(spark, [(i, f"d{i}/x", t) for i, t in enumerate(texts)])
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        name, score = _plain(text)
        assert got[i]["license"] == name, (i, text)
        assert score is None or abs(got[i]["score"] - score) < 2e-6
    assert sum(r["license"] is not None for r in got.values()) > 80


def test_whole_files_declared_and_wrapped_licences(spark):
    mit = next(t for n, t in reversed(L.TEMPLATES) if n == "MIT")
    three = next(t for n, t in L.TEMPLATES if n == "BSD-3-Clause")
    prose = " ".join(f"word{i}" for i in range(180))
    rows = [(1, "p/LICENSE", "MIT License\n\nCopyright (c) 2024 A Person\n\n" + mit), (2, "p/a.py", "print(1)\n" * 100),
            (3, "q/b.c", "/* SPDX-License-Identifier: Apache-2.0 */\nint main;"),
            (4, "q/c.py", "# Redistribution and use in source and binary\n# forms, with or without modification,\n# are permitted.\nx"),
            (5, "q/d.md", "Some text.\n\nCC BY 4.0"), (6, "r/e.py", _commented(three) + "\n" + "code = 1\n" * 300),
            (7, "s/COPYING.md", prose + "\nReleased under the MIT License"), (8, "s/t/u/f", "none here"),
            (9, "v/notes.md", prose + "\nReleased under the MIT License"), (10, "v/f", "none here"),
            (11, None, "none here"), (12, "w", "none here")]
    got = {k: (r["license"], r["origin"], r["license_dir"]) for k, r in _scan(spark, rows).items()}
    assert got == {1: ("MIT", "header", None), 2: ("MIT", "inherited", "p"), 3: ("Apache-2.0", "header", None),
                   4: ("BSD-2-Clause", "header", None), 5: ("CC-BY-4.0", "header", None), 6: ("BSD-3-Clause", "header", None),
                   7: ("MIT", "header", None), 8: ("MIT", "inherited", "s"), 9: ("MIT", "header", None), 10: (None, "none", None),
                   11: (None, "none", None), 12: (None, "none", None)}


def test_repeated_rows_and_many_blank_lines(spark):
    text = "\n" * 200_000 + "Released under the MIT License"
    files = spark.createDataFrame([(None, "a/x", text)] * 3 + [(1, "a/b/y", None)] * 2, "doc_id long, path string, text string")
    got = [(r["doc_id"], r["license"], r["origin"]) for r in L.scan_licenses(files).collect()]
    assert sorted(got, key=str) == sorted([(None, "MIT", "header")] * 3 + [(1, "MIT", "inherited")] * 2, key=str)


def test_more_words(spark):
    from pyspark.sql import functions as F
    texts = ["", "a", " a b ", "a b c", "a b c d", "\ta\nb\vc\x1cd e", "a b c d"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r[0]: r[1] for r in df.select("text", L.more_words(F.col("text"), 3)).collect()}
    assert got == {t: len(re.findall("[^\\x20\\x09-\\x0D]+", t)) > 3 for t in texts}
