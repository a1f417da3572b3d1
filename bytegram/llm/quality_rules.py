"""Quality rules by distribution divergence.

Each document's histograms of character classes and of common words are compared with references for languages by
Jensen-Shannon distance (the square root of the divergence in bits, 0 to 1). The references are means over all
documents of a language that pass the base rules and the length guards. A document is judged on a histogram only if it
is long enough for it. Common words are a fifth of a text, so even a document without any is not far away in words: the
limit is a share of that distance.

Each ``lang`` with enough documents has a reference of classes, those of ``COMMON_WORDS`` one of words as well. The nearest
counts of the references of the ``COMMON_WORDS`` languages, that of the document's own ``lang`` and, if most letters are
beyond ASCII, those of which the same is true: so a wrong ``lang`` does no harm. A document in a language without a
reference is not judged by it. One without a ``lang`` is judged like those of ``COMMON_WORDS``, unless most of its letters
are beyond ASCII: then on classes only, and only if a reference is of that kind.

Null and empty texts have no words and fail the base rule. Repeated rows and null ids are judged like others. If no
document of any language can serve as a reference, no document is rejected by divergence.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegram.llm.common import written

#: Common words of each language with a reference (public stop-word knowledge).
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as be by",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht",
    "fr": "de la le et les des en un du une que est pour qui dans au",
    "es": "de la que el en y a los se del las un por con una su",
}
CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "letter_beyond_ascii", "control")
#: Largest class distance of a document that stays, and the fewest characters or words for which a distance counts.
MAX_CLASS_DISTANCE = 0.27
MIN_CHARS, MIN_WORDS = 200, 100
#: Largest word distance of a document that stays, as a share of what a document without any common word is away, and
#: the least share of common words in a language's reference for which its word distance counts.
MAX_WORD_SHARE, MIN_COMMON = 0.80, 0.05
#: Fewest documents that make a reference.
MIN_DOCUMENTS = 5

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


def _class_of_byte() -> np.ndarray:
    out = np.full(256, CLASSES.index("mark"))
    for name, some in (("control", [*range(32), 127]), ("space", _SPACE), ("digit", b"0123456789"),
                       ("lower", range(97, 123)), ("upper", range(65, 91)), ("symbol", _SYMBOLS + b"=@[\\]^_`{}~+/"),
                       ("letter_beyond_ascii", range(0xC0, 256))):
        out[list(some)] = CLASSES.index(name)
    out[0x80:0xC0] = len(CLASSES)  # later bytes of a character: not counted
    return out


_CLASS = _class_of_byte()
_VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
BINS = len(CLASSES) + len(_VOCABULARY) + 1


def repeated_words(codes: np.ndarray, window: int = 5) -> int:
    """Number of positions that lie in a window of words found twice or more."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    name = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        name = (name ^ (name >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + n]
    ordered = np.sort(name)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.flatnonzero(np.isin(name, twice))
    step = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + window, -1)
    return int((np.cumsum(step) > 0).sum())


def statistics(docs: DataFrame) -> DataFrame:
    """Base counts and histogram (``bins``: counts of the classes, of the common words, of all other words)."""
    columns = ("doc_id", "lang", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.array([hash(form.encode()) for w in _VOCABULARY for form in (w, w.capitalize(), w.upper())],
                        dtype=np.int64)
        slots = np.repeat(np.arange(len(_VOCABULARY)), 3)
        order = np.argsort(keys, kind="stable")
        keys, slots = keys[order], slots[order]
        for batch in batches:
            rows: list[tuple] = []
            bins = np.zeros((batch.num_rows, BINS), dtype=np.int64)
            for i, value in enumerate(batch.column(3)):
                text = value.as_py() or b""
                count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
                points = int(count.sum() - count[0x80:0xC0].sum())
                words = text.split()
                codes = np.fromiter(map(hash, words), np.int64, len(words))
                seen, copies = set(), 0
                for line in text.split(b"\n"):
                    if line in seen:
                        copies += 1
                    elif line and not line.isspace():
                        seen.add(line)
                at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
                slot = np.where(keys[at] == codes, slots[at], len(_VOCABULARY))
                bins[i, :len(CLASSES)] = np.bincount(_CLASS, weights=count, minlength=len(CLASSES) + 1)[:-1]
                bins[i, len(CLASSES):] = np.bincount(slot, minlength=len(_VOCABULARY) + 1)
                rows.append((len(words), points - int(count[list(_SPACE)].sum()), int(count[list(_SYMBOLS)].sum()),
                             copies, repeated_words(codes.view(np.uint64))))
            sums = [pa.array([r[c] for r in rows], pa.int64()) for c in range(5)]
            flat = pa.FixedSizeListArray.from_arrays(pa.array(bins.reshape(-1)), BINS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), *sums, flat],
                                             names=[*columns, "bins"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.xxhash64("text").alias("text_hash"),
                       F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, lang string, text_hash long, " + ", ".join(f"{c} long" for c in columns[3:])
        + ", bins array<long>")


def _shares(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    classes, words = bins[:, :len(CLASSES)].astype(float), bins[:, len(CLASSES):].astype(float)
    return tuple(h / np.maximum(h.sum(axis=1, keepdims=True), 1) for h in (classes, words))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` to the one distribution ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def word_shares(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Least distance of each row of word shares to the word references, as a share of that of a document without common
    words; 0 if no reference holds enough of them."""
    bare = np.zeros((1, known.shape[1]))
    bare[0, -1] = 1
    some = [js_distance(words, r) / js_distance(bare, r)[0] for r in known if 1 - r[-1] >= MIN_COMMON]
    return np.min(some, axis=0) if some else np.zeros(len(words))


def references(stats: DataFrame) -> dict[str, np.ndarray]:
    """Class shares and word shares, in one row, of each language that has documents enough.

    Means over all its documents that pass the base rules and are long enough; only these few rows reach the driver.
    """
    good = stats.filter(~F.col("base_failed") & (F.col("n_words") >= MIN_WORDS) & F.col("lang").isNotNull())
    size = len(CLASSES)
    classes = F.slice("bins", 1, size)
    words = F.slice("bins", size + 1, BINS - size)
    chars = F.aggregate(classes, F.lit(0).cast("long"), lambda a, x: a + x)
    shares = F.concat(F.transform(classes, lambda x: x / chars), F.transform(words, lambda x: x / F.col("n_words")))
    means = (good.select("lang", F.posexplode(shares).alias("slot", "share"))
             .groupBy("lang", "slot").agg(F.avg("share").alias("share"), F.count("*").alias("n"))
             .filter(F.col("n") >= MIN_DOCUMENTS).collect())
    out = {lang: np.zeros(BINS) for lang in sorted({r["lang"] for r in means})}
    for r in means:
        out[r["lang"]][r["slot"]] = r["share"]
    return out


def beyond_ascii(classes: np.ndarray) -> np.ndarray:
    """Of each row of class counts or shares, whether most letters are beyond ASCII."""
    lower, upper, beyond = (classes[:, CLASSES.index(c)] for c in ("lower", "upper", "letter_beyond_ascii"))
    return beyond > lower + upper


def quality(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash``, the base counts, ``base_failed, class_distance, word_distance, kept`` of each row."""
    stats = statistics(docs).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    stats = written(stats, "quality")
    by_lang = references(stats)
    size = len(CLASSES)
    known = np.array([*by_lang.values()]).reshape(-1, BINS)
    at = {lang: i for i, lang in enumerate(by_lang)}
    common = np.array([lang in COMMON_WORDS for lang in by_lang], dtype=bool)
    other = beyond_ascii(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(-1, BINS)
            classes, words = _shares(bins)
            langs = batch.column("lang").to_pylist()
            own, none = np.array([at.get(x, -1) for x in langs]), np.array([x is None for x in langs])
            beyond = beyond_ascii(classes)
            near = [np.zeros(len(bins)), np.zeros(len(bins))]
            if len(known):
                fits = common[:, None] | (np.arange(len(known))[:, None] == own) | other[:, None] & beyond
                least = np.min(np.where(fits, [js_distance(classes, r) for r in known[:, :size]], np.inf), axis=0)
                near[0] = np.where(np.isinf(least), 0, least)
            if common.any():
                near[1] = np.min([js_distance(words, r) for r in known[common, size:]], axis=0)
            by_class = (own >= 0) | none & ~(beyond & ~other.any())
            by_words = ~beyond & (none | (own >= 0) & np.append(common, False)[own])
            n, chars = batch.column("n_words").to_numpy(), bins[:, :size].sum(axis=1)
            share = word_shares(words, known[common, size:])
            far = (by_class & (near[0] > MAX_CLASS_DISTANCE) & (chars >= MIN_CHARS)
                   | by_words & (share > MAX_WORD_SHARE) & (n >= MIN_WORDS))
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
            keep = [c for c in batch.schema.names if c not in ("bins", "lang")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(near[0]), pa.array(near[1]), pa.array(~failed & ~far)],
                names=[*keep, "class_distance", "word_distance", "kept"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema if f.name not in ("bins", "lang"))
    return stats.mapInArrow(run, kept + ", class_distance double, word_distance double, kept boolean")
