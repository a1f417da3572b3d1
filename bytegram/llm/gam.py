"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the text alone are cut into quantile bins. Cyclic boosting visits one feature after the other, again and
again, with a shallow tree over its bins each time; the trees of a feature add up to one lookup table. The pairs with the
largest gain get a table over their bins in the same way. A score is the logistic function of a sum of table entries.

The model is fitted on the driver from at most ``max_rows`` labelled documents (those with the smallest hash of their
id), outside the held-out fold; everything else runs over all rows. Empty and null texts are scored like others. If
no label is usable, or all are alike, scores are the share of ones (0.5 without labels). Repeated rows are all scored;
of repeated ids one row is fitted on. Null ids are not held out.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegram.llm.common import fold
from bytegram.llm.quality_rules import _CLASS, CLASSES, repeated_words

MAX_ROWS, BINS, PAIR_BINS, PAIRS = 20_000, 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAF_ROWS = 150, 60, 0.2, 5
FEATURES = ("log_words", "log_bytes", "mean_word", "deviation_word", "longest_word", *(f"share_{c}" for c in CLASSES),
            "bars", "exclamations", "stops", "distinct_words", "commonest_word", "log_lines", "words_per_line",
            "repeated_lines", "repeated_windows", "sentence_ends", "capital_words")


def features(text: bytes) -> list[float]:
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = np.bincount(_CLASS, weights=count, minlength=len(CLASSES) + 1)[:-1]
    words = text.split()
    n, chars = len(words), max(1.0, float(classes.sum()))
    sizes = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    codes = np.fromiter(map(hash, words), np.int64, n)
    ordered = np.sort(codes)
    edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if n else np.array([0, 0])
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    some = max(1, n)
    return [np.log1p(n), np.log1p(len(text)), sizes.mean(), sizes.std(), np.log1p(sizes.max()), *(classes / chars),
            count[124] / some, count[33] / some, count[46] / some, (len(edges) - 1) / some, np.diff(edges).max() / some,
            np.log1p(len(lines)), n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
            repeated_words(codes.view(np.uint64)) / some, sum(w.endswith(b".") for w in words) / some,
            sum(w[:1].isupper() for w in words) / some]


def _tree(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Value of each bin in a tree of a few leaves over ordered bins, grown by the best next cut."""
    g, h, c = (np.concatenate([[0], np.cumsum(x)]) for x in (gradient, weight, rows))
    cuts = [0, len(gradient)]

    def gain(a, b):
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)

    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            k = np.arange(a + 1, b)
            if not len(k):
                continue
            better = np.where((c[k] - c[a] >= LEAF_ROWS) & (c[b] - c[k] >= LEAF_ROWS), gain(a, k) + gain(k, b) - gain(a, b), 0)
            if better.max() > best[0]:
                best = (better.max(), int(k[better.argmax()]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(gradient))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of a grid in the tree that cuts both features once, and its gain over no cut."""
    def quarters(x):
        s = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
        s[1:, 1:] = x.cumsum(0).cumsum(1)
        a = s[1:-1, 1:-1]
        top, left = s[1:-1, -1:], s[-1:, 1:-1]
        return np.stack([a, top - a, left - a, s[-1, -1] - top - left + a])

    g, h, c = quarters(gradient), quarters(weight), quarters(rows)
    gain = (g ** 2 / (h + 1.0)).sum(0) - gradient.sum() ** 2 / (weight.sum() + 1.0)
    gain = np.where(c.min(0) >= LEAF_ROWS, gain, 0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros(gradient.shape)
    if gain[i, j] > 1e-9:
        v = (g / (h + 1.0))[:, i, j]
        out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = v
    return out, float(gain[i, j])


class AdditiveModel:
    """Lookup tables by feature and by pair of features."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        self.base = float(np.log(share / (1 - share)))
        width = len(FEATURES)
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.zeros(0)
                      for f in range(width)]
        self.coarse = [e[np.linspace(0, len(e) - 1, min(PAIR_BINS - 1, len(e))).astype(int)] if len(e) else e for e in self.edges]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []
        if not len(y) or y.min() == y.max():
            return self
        bins, total = self._bins(x, self.edges), np.full(len(y), self.base)

        def state():
            p = 1 / (1 + np.exp(-total))
            return y - p, p * (1 - p)

        sizes = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, self.tables)]
        for _ in range(ROUNDS):
            for f, table in enumerate(self.tables):
                g, h = state()
                step = RATE * _tree(np.bincount(bins[f], g, len(table)), np.bincount(bins[f], h, len(table)), sizes[f])
                table += step
                total += step[bins[f]]
        cells = self._bins(x, self.coarse)
        shape = [len(e) + 1 for e in self.coarse]

        def grid(a, b, values):
            return np.bincount(cells[a] * shape[b] + cells[b], values, shape[a] * shape[b]).reshape(shape[a], shape[b])

        g, h = state()
        one = np.ones(len(y))
        gains = sorted(((_pair_tree(grid(a, b, g), grid(a, b, h), grid(a, b, one))[1], a, b)
                        for a in range(width) for b in range(a) if min(shape[a], shape[b]) > 1), reverse=True)
        self.pairs = [(a, b) for gain, a, b in gains[:PAIRS] if gain > 0]
        self.grids = [np.zeros((shape[a], shape[b])) for a, b in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (a, b), values in zip(self.pairs, self.grids):
                g, h = state()
                step = RATE * _pair_tree(grid(a, b, g), grid(a, b, h), grid(a, b, one))[0]
                values += step
                total += step[cells[a], cells[b]]
        return self

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for b, table in zip(self._bins(x, self.edges), self.tables):
            total += table[b]
        cells = self._bins(x, self.coarse)
        for (a, b), values in zip(self.pairs, self.grids):
            total += values[cells[a], cells[b]]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py() or b"") for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> AdditiveModel:
    """A model of ``labels.quality`` from documents outside the held-out fold."""
    sample = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~fold(labels, 4, 2))
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))],
                                             names=["doc_id", "quality", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = (texts.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")  # at most max_rows small rows
            .mapInArrow(run, "doc_id long, quality double, x array<double>").dropDuplicates(["doc_id"]).orderBy("doc_id").collect())
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(-1, len(FEATURES))
    return AdditiveModel().fit(x, np.array([r["quality"] >= 0.5 for r in rows], dtype=np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document."""
    model = fit(docs, labels, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(docs, 4, 2).alias("held_out"),
                       F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
