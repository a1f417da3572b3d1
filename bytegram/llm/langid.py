"""Language identification by hierarchical discrimination.

Languages are grouped into families by average linkage of their mean character n-grams. Linear support vector machines
(one against the rest) predict the family; inside a family, one linear support vector machine for each pair of its
languages separates the close ones, by votes and then by margins.

Features are hashed n-grams (one to three bytes, lower case, everything but letters as one blank) of the whole text. The
model is fitted on the driver from documents outside the held-out fold: of each language those with the smallest hashes of
id and text, ``max_rows`` in all or at least ``MIN_EACH`` for each language, as far as there are so many; rows that repeat
count once. All rows are scored. Null texts and texts without a letter are ``und`` with score 0. Without any usable label,
all are ``und``. Repeated rows and null ids are scored like others. Labels are the values of ``lang`` as they stand; every
one that occurs is learned.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytegram.llm.common import fold, written

WIDTH, MAX_ROWS, MIN_EACH = 2048, 3000, 10
#: A document is taken as it is and as this many short runs of its words, so that short texts are learned as well.
PARTS, PART_BYTES = 1, 80

_FOLDED = np.full(256, 32, dtype=np.uint32)
_FOLDED[97:123] = _FOLDED[65:91] = np.arange(97, 123)
_FOLDED[128:] = np.arange(128, 256)


def has_letter(text: bytes) -> bool:
    raw = np.frombuffer(text, np.uint8)
    if ((raw | 32) - 97 < 26).any():
        return True
    return bool((raw > 127).any()) and any(c.isalpha() for c in text.decode("utf-8", "replace") if c > "\x7f")


def vector(text: bytes) -> np.ndarray:
    """Square roots of hashed n-gram counts, at unit length."""
    b = _FOLDED[np.frombuffer(text, np.uint8)]
    b = np.concatenate([[32], b[(b != 32) | (np.concatenate([[0], b[:-1]]) != 32)] if len(b) else b, [32]]).astype(np.uint32)
    two = b[:-1] * np.uint32(256) + b[1:]
    three = two[:-1] * np.uint32(256) + b[2:]
    shift = np.uint32(32 - WIDTH.bit_length() + 1)
    out = np.zeros(WIDTH)
    for k, grams in enumerate((b, two, three)):
        out += np.bincount(((grams + np.uint32(k << 29)) * np.uint32(2654435761)) >> shift, minlength=WIDTH)
    out = np.sqrt(out)
    return (out / max(np.linalg.norm(out), 1e-9)).astype(np.float32)


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])


def svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 250) -> np.ndarray:
    """Weights (the last one constant) of a linear support vector machine, squared hinge, both sides weighed alike."""
    x = _with_one(x)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], dtype=np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - 0.24 * (ridge * ahead - 2 * x.T @ (weight * y * slack))
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


class FamilyModel:
    """Families of languages, and the machines for families and for pairs inside them."""

    def fit(self, x: np.ndarray, lang: np.ndarray) -> FamilyModel:
        self.langs = sorted(set(lang.tolist()))
        means = np.array([x[lang == a].mean(axis=0) for a in self.langs])
        means /= np.linalg.norm(means, axis=1, keepdims=True) if len(means) else 1
        near = means @ means.T
        groups = [[i] for i in range(len(self.langs))]
        sums = near.astype(np.float64)
        while len(groups) > max(1, round(len(self.langs) ** 0.5)):
            n = np.array([len(g) for g in groups])
            mean = np.where(np.triu(np.ones(sums.shape, dtype=bool), 1), sums / np.outer(n, n), -np.inf)
            a, b = divmod(int(mean.argmax()), len(groups))
            groups[a] += groups.pop(b)
            sums[a] += sums[b]
            sums[:, a] += sums[:, b]
            sums = np.delete(np.delete(sums, b, 0), b, 1)
        self.families = [[self.langs[i] for i in g] for g in groups]
        family = {a: k for k, g in enumerate(self.families) for a in g}
        of = np.array([family[a] for a in lang.tolist()])
        self.rest = [svm(x, np.where(of == k, 1, -1).astype(np.float32)) for k in range(len(groups))] if len(groups) > 1 else []
        self.pairs = {}
        for g in self.families:
            for a, b in combinations(g, 2):
                here = (lang == a) | (lang == b)
                self.pairs[a, b] = svm(x[here], np.where(lang[here] == a, 1, -1).astype(np.float32))
        return self

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = _with_one(x)
        margin = np.stack([x @ w for w in self.rest], axis=1) if self.rest else np.zeros((len(x), 1))
        sure = np.exp(3 * (margin - margin.max(axis=1, keepdims=True)))
        sure /= sure.sum(axis=1, keepdims=True)
        chosen = margin.argmax(axis=1)
        out, score = np.empty(len(x), dtype=object), np.zeros(len(x))
        for k, g in enumerate(self.families):
            at = np.flatnonzero(chosen == k)
            votes = np.zeros((len(at), len(g)))
            for (i, a), (j, b) in combinations(enumerate(g), 2):
                p = 1 / (1 + np.exp(-3 * np.clip(x[at] @ self.pairs[a, b], -50, 50)))
                votes[:, i] += (p >= 0.5) + 0.01 * p
                votes[:, j] += (p < 0.5) + 0.01 * (1 - p)
            best = votes.argmax(axis=1)
            inner = np.ones(len(at))
            for (i, a), (j, b) in combinations(enumerate(g), 2):
                p = 1 / (1 + np.exp(-3 * np.clip(x[at] @ self.pairs[a, b], -50, 50)))
                inner = np.where(best == i, np.minimum(inner, p), np.where(best == j, np.minimum(inner, 1 - p), inner))
            out[at] = np.array(g, dtype=object)[best]
            score[at] = sure[at, k] * inner
        return out.tolist(), score


def _parts(text: bytes, name: int) -> list[bytes]:
    words = text.split()
    out = [text]
    for k in range(PARTS if words and len(text) > 2 * PART_BYTES else 0):
        begin = (name * 7919 + k * 104729) % len(words)
        out.append(b" ".join(words[begin:begin + 12])[:PART_BYTES])
    return [t for t in out if has_letter(t)]


def training_rows(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``lang, hash, doc_id, text`` of the documents to fit on: the same number for each language that occurs."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~fold(docs, 3, 1))
    known = known.select("lang", F.xxhash64("doc_id", "text").alias("hash"), "doc_id", "text")
    names = written(known.select("lang", "hash").distinct(), "training-names")
    counts = names.groupBy("lang").agg(F.count("*").alias("n"))
    each = max(MIN_EACH, max_rows // max(1, counts.count()))
    part = F.pmod("hash", F.lit(1 << 30))
    few = names.join(F.broadcast(counts), "lang").filter(part / float(1 << 30) < (2 * each + 50) / F.col("n"))
    order = Window.partitionBy("lang").orderBy(part, "hash")  # at most some 2 * each + 50 rows of a language
    few = few.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each).select("lang", "hash")
    return known.join(F.broadcast(few), ["lang", "hash"]).dropDuplicates(["lang", "hash"])


def fit(docs: DataFrame, max_rows: int = MAX_ROWS) -> FamilyModel | None:
    """A model of ``lang`` from documents outside the held-out fold; none if there is nothing to learn from."""
    sample = training_rows(docs, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, vector(t).tobytes()) for lang, text, name in zip(*(batch.column(c).to_pylist() for c in range(3)))
                    for t in _parts(text, name)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())],
                                             names=["lang", "x"])

    sample = sample.select("lang", F.col("text").cast("string").cast("binary").alias("text"),
                           F.abs(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) % 1_000_003).alias("name"))
    rows = sample.mapInArrow(run, "lang string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.empty((len(rows), WIDTH), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(bytes(r["x"]), np.float32)
    lang = np.array([r["lang"] for r in rows], dtype=object)
    del rows
    return FamilyModel().fit(x, lang)


def identify(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each document."""
    model = fit(docs, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t.as_py() or b"" for t in part.column(2)]
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
                where = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
                if where:
                    found, sure = model.predict(np.stack([vector(texts[i]) for i in where]))
                    score[where] = np.clip(sure, 0, 1)
                    for i, name in zip(where, found):
                        lang[i] = name
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score)],
                                                 names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(docs, 3, 1).alias("held_out"),
                       F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
