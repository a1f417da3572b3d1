"""Spelling variant grouping over the vocabulary of a corpus: words one edit apart, their commonest form, their root.

Neighbourhoods are searched by Bloom filters. Words are sharded by length; each shard has a blocked filter (all bits of
a word in one block of 512), built by a bitwise-or aggregate and broadcast. Tasks generate the edits of their words as
hashes only: an edit changes a polynomial hash by one term, so that an edit costs one step whatever the word's length.
Only edits that the filter of their length has seen become strings, are shuffled and joined with the vocabulary, which
removes false positives. Deletions are generated at the longer word and replacements at the word that comes
first, so that each pair of near words is found once; no pair is ever emitted through a third string.

All filters together stay below ``MAX_FILTER_BYTES``, whatever the vocabulary: beyond about 40 million words their false
positives grow, and with them the rows that the exact join drops, but never its result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytegram.llm.common import only, written

#: Letters of a word: fixed ranges of code points, all below 256.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABET = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], dtype=np.uint64)
#: Bits of filter for each word, and bits set by it.
BITS, SET = 12, 6
MAX_FILTER_BYTES = 64 << 20
#: Words of this length and over share a shard.
LONGEST = 40
#: Edits looked up at once.
TOGETHER = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def occurrences(docs: DataFrame, divisor: int = 97) -> DataFrame:
    """``word`` for every run of letters: lower-cased in A-Z, and one of about ``divisor`` runs with a letter deleted.

    The run ``r`` of a document loses its code point ``h % length`` where ``divisor`` divides ``h``, the crc32 of
    ``<doc_id>:<r>`` (null id: empty before the colon). Null texts have no runs.
    """
    lower = F.translate("text", UPPER, UPPER.lower())
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.withColumn("h", h).select(F.when(F.col("h") % divisor == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """``word, n`` over all documents; counts are summed up in each task before they are shuffled."""
    words = occurrences(docs).filter(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each mixed hash."""
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def _bit(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit slot in its block, and the bit in that slot, that each mixed hash sets as its ``k``-th."""
    nine = (h >> np.uint64(9 * k)) & np.uint64(511)
    return nine >> np.uint64(6), np.uint64(1) << (nine & np.uint64(63))


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the rows of the words of that length, and their letters as a matrix."""
    coded = [w.encode("latin-1") for w in words.to_pylist()]
    size = np.array([len(w) for w in coded])
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        step = max(1, TOGETHER // n)
        for i in range(0, len(rows), step):
            some = rows[i:i + step]
            letters = np.frombuffer(b"".join(coded[r] for r in some), dtype=np.uint8).reshape(len(some), n)
            yield some, letters.astype(np.uint64)


def shard_blocks(words: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> dict[int, int]:
    """Blocks of the filter of each shard; at most ``LONGEST`` shards, whose bytes are ``max_bytes`` at most."""
    shard = F.least(F.length("word"), F.lit(LONGEST))
    counts = {r[0]: r[1] for r in words.groupBy(shard.alias("shard")).count().collect()}
    scale = min(1.0, max_bytes * 8 / max(1, BITS * sum(counts.values()) + 512 * len(counts)))
    return {k: max(1, int(-(-n * BITS // 512) * scale)) for k, n in counts.items()}


def filters(words: DataFrame, blocks: dict[int, int]) -> dict[int, np.ndarray]:
    """The filter of each shard, as 64-bit slots: made by tasks, joined by ``bit_or`` for each slot."""
    schema = pa.schema([("shard", pa.int32()), ("slot", pa.int64()), ("bits", pa.int64())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, letters in _by_length(batch.column(0)):
                n = letters.shape[1]
                shard = min(n, LONGEST)
                h = _mixed((letters * _powers(n)).sum(axis=1, dtype=np.uint64))
                places = [_bit(_mixed(h + _BASE), k) for k in range(SET)]
                slot = np.concatenate([_block(h, blocks[shard]) * np.uint64(8) + s for s, _ in places])
                bits = np.concatenate([b for _, b in places])
                order = np.argsort(slot, kind="stable")
                slot, first = np.unique(slot[order], return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slot), shard, dtype=np.int32)), pa.array(slot.astype(np.int64)),
                     pa.array(np.bitwise_or.reduceat(bits[order], first).view(np.int64))], schema=schema)

    slots = (words.select("word").mapInArrow(made, "shard int, slot long, bits long")
             .groupBy("shard", "slot").agg(F.bit_or("bits").alias("bits")).toArrow())
    out = {k: np.zeros(8 * n, dtype=np.uint64) for k, n in blocks.items()}
    shards, at, bits = (slots.column(c).to_numpy() for c in range(3))
    for k, table in out.items():
        here = shards == k
        table[at[here]] = bits[here].view(np.uint64)
    return out


def _seen(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Indices of the (flat) hashes that a filter may hold; with each bit, fewer are left to look at."""
    left, h = np.arange(len(h)), _mixed(h)
    block, h = _block(h, len(table) // 8) * np.uint64(8), _mixed(h + _BASE)
    for k in range(SET):
        slot, bit = _bit(h, k)
        hit = (table[(block + slot).astype(np.int64)] & bit) != 0
        left, block, h = left[hit], block[hit], h[hit]
    return left


def _replaced(letters: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``row, place, new letter`` of replacements by a later letter that the filter has seen."""
    rows, n = letters.shape
    power = _powers(n)
    whole = (letters * power).sum(axis=1, dtype=np.uint64)
    wide = max(1, TOGETHER // len(ALPHABET))
    deep = max(1, wide // n)
    for r in range(0, rows, deep):
        for p in range(0, n, wide):
            part = letters[r:r + deep, p:p + wide]
            row, place, letter = np.nonzero(ALPHABET > part[:, :, None])
            h = whole[r + row] + (ALPHABET[letter] - part[row, place]) * power[p + place]
            at = _seen(table, h)
            yield r + row[at], p + place[at], ALPHABET[letter[at]]


def _deleted(letters: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``row, place`` of deletions that the filter has seen; of a run of one letter, only its first is deleted."""
    rows, n = letters.shape
    low = np.cumsum(letters * _powers(n), axis=1, dtype=np.uint64) - letters * _powers(n)
    shifted = letters[:, 1:] * _powers(n - 1)
    high = np.zeros_like(letters)
    high[:, :-1] = np.cumsum(shifted[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    new = np.ones(letters.shape, dtype=bool)
    new[:, 1:] = letters[:, 1:] != letters[:, :-1]
    row, place = np.nonzero(new)
    at = _seen(table, (low + high)[row, place])
    yield row[at], place[at]


def candidates(words: DataFrame, tables) -> DataFrame:
    """``word, n, other``: edits that the broadcast filters have seen. Each near pair is among them once."""
    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tables.value
        for batch in batches:
            for rows, letters in _by_length(batch.column(0)):
                n = letters.shape[1]
                small = letters.astype(np.uint8)
                out: list[tuple[np.ndarray, list[str]]] = []
                if min(n, LONGEST) in held:
                    for row, place, letter in _replaced(letters, held[min(n, LONGEST)]):
                        made = small[row]
                        made[np.arange(len(row)), place] = letter
                        out.append((row, [x.tobytes().decode("latin-1") for x in made]))
                if n > 1 and min(n - 1, LONGEST) in held:
                    for row, place in _deleted(letters, held[min(n - 1, LONGEST)]):
                        texts = [small[r].tobytes().decode("latin-1") for r in row]
                        out.append((row, [t[:p] + t[p + 1:] for t, p in zip(texts, place.tolist())]))
                for row, other in out:
                    if len(row):
                        whose = pa.array(rows[row])
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(whose), batch.column(1).take(whose), pa.array(other, pa.string())],
                            names=["word", "n", "other"])

    return words.select("word", "n").mapInArrow(probed, "word string, n long, other string")


def near_pairs(words: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``word, n, other, other_n``: every two words of ``word, n`` one edit apart, in both directions."""
    tables = words.sparkSession.sparkContext.broadcast(filters(words, shard_blocks(words, max_bytes)))
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = written(candidates(words, tables).join(known, "other").select("word", "n", "other", "other_n"), "near")
    tables.destroy()
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"),
                                          F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: forms followed to the last, twice as far with each round.

    A form has at least twice its word's count, so that chains have no circles and are as long as a logarithm.
    """
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = written(at.join(step, at["root"] == step["_word"], "left").select(
            "word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")), "roots")
        at = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return at


def variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2,
             max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of at least ``min_length`` letters and ``min_count`` uses.

    Two words are near if one inserted, deleted or replaced letter makes them equal. The form of a word is its near word
    with the largest count (ties: first in code-point order) if that is at least ``ratio`` times the word's own.
    Repeated rows count as often as they occur. An empty table, or one of null texts, gives no row.
    """
    words = written(vocabulary(only(docs, ("doc_id", "text")), min_length, min_count), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("other")))
    near = near_pairs(words, max_bytes).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.minus") >= ratio * F.col("n")
    words = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.other")).alias("form"),
        F.when(enough, -F.col("best.minus")).alias("form_n")), "forms")
    last = roots(words.filter("form IS NOT NULL"))
    return words.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
