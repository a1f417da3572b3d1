"""Removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

A string of ``length`` bytes that occurs twice has the same smallest-hashed 64-byte gram (the leftmost, on ties) at the
same place in both occurrences. So only suffixes that start at such grams enter the arrays (about 1.5 % of all at 200
bytes). An array holds the names of its suffixes' first 64 bytes, in name order: for matches this long only equality
of prefixes counts, so names (64-bit fingerprints) stand in for lexicographic order.

Documents come in batches. Each new batch is merge-scanned against all existing levels in one sorted aggregation, which
marks names that it shares with itself or with any level; as in a binary counter, levels of equal size merge with it in
the same pass. The marked names give candidates; an exact check follows:

* An entry's text is the union of all windows that share its gram. Entries of one name with equal texts (a class, 128
  bits with the name) prove each other repeated as a whole.
* If classes of a name differ (at the edges of a passage), one entry of each class is looked into: first by strings that
  all windows of a quarter of it hold, then, where two classes share such a string, window by window. Windows that two
  classes share are repeated.

No pairs are made: copies only add to counts. Matches never cross documents. Null texts are empty and stay as they are,
repeated rows are copies of each other, null ids are allowed, an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegram.llm.common import dropped, released, shared, sorted_join, written

GRAM = 64
#: Windows that are looked at together; longer texts are taken in pieces.
TOGETHER = 1 << 19
#: Texts that a Python worker gets at a time.
BATCH_ROWS = 1000
_PLACE = 22  # bits of a place inside such a piece
_SPAN = 17  # bits of a span, behind the place of a run's first window
_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, 300, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE, _STEP = _RANDOM[:256], _RANDOM[256:]


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = x * _STEP[k]
    return x ^ (x >> np.uint64(31))


def _grams(data: np.ndarray) -> np.ndarray:
    """Fingerprints of the 64-byte strings that start at each place."""
    h = _BYTE[data]
    for k in range(6):
        step = 1 << k
        h = _mix(h[:-step], k) + h[step:]
    return h


def _window(gram: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of the ``length``-byte strings at these places: 64-byte grams, the last one shifted to the end."""
    out = gram[at]
    for k, step in enumerate([*range(GRAM, length - GRAM, GRAM), length - GRAM]):
        out = _mix(out, 8 + k % 16) + gram[at + step]
    return _mix(out, 30)


def _slide(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest fingerprint in each run of ``width`` places."""
    low = np.uint64((1 << _PLACE) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    n = len(v) - width + 1
    rows = -(-len(v) // width)
    grid = np.full(rows * width, ~np.uint64(0))
    grid[:len(v)] = v
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:n], ahead[width - 1:width - 1 + n]) & low).astype(np.int64)


def entries(pieces: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """``row, low, span, name, cls`` of all entries in pieces of text ``(row, offset in the text, bytes)``.

    An entry is a run of windows, ``low`` to ``low + span``, whose smallest gram is the same one.
    """
    sizes = np.array([len(p[2]) for p in pieces], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    gram = _grams(data)
    anchor = _slide(gram, length - GRAM + 1)
    valid = np.zeros(len(anchor), dtype=bool)
    for b, n in zip(begins.tolist(), sizes.tolist()):
        valid[b:b + n - length + 1] = True
    at = np.flatnonzero(valid)
    own = anchor[at]
    first = np.ones(len(at), dtype=bool)
    first[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    low = at[first]
    high = at[np.concatenate([first[1:], [True]])] if len(at) else low
    name, span = gram[own[first]], high - low
    cls = _mix(_mix(_window(gram, low, length), 40) + _window(gram, high, length), 41) + span.astype(np.uint64)
    piece = np.searchsorted(begins, low, side="right") - 1
    rows, offsets = (np.array([p[k] for p in pieces], dtype=np.int64) for k in (0, 1))
    return rows[piece], low - begins[piece] + offsets[piece], span, name.view(np.int64), cls.view(np.int64)


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    held, size = [], 0
    for row, text in enumerate(texts):
        for begin in range(0, max(0, len(text) - length + 1), TOGETHER):
            held.append((row, begin, text[begin:begin + TOGETHER + length - 1]))
            size += len(held[-1][2])
            if size >= TOGETHER:
                yield held
                held, size = [], 0
    if held:
        yield held


def _keyed(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``id, hash`` name a text (repeated rows share a name, and so their removals), with its bytes and ``row``."""
    text = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(f"_{c}") for c in carry])
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
                       F.xxhash64("text").alias("hash"), text.alias("text"), row.alias("row"))


def all_entries(docs: DataFrame, length: int, batches: int) -> DataFrame:
    """The entries of all texts, written with a ``batch`` each: ``id, hash, place, name, cls``."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ids, hashes = (batch.column(c).to_numpy() for c in (0, 1))
            for some in _pieces([t.as_py() for t in batch.column(2)], length):
                row, low, span, name, cls = entries(some, length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], hashes[row], (low << _SPAN) | span, name, cls)],
                                                 names=["id", "hash", "place", "name", "cls"])

    found = _keyed(docs).select("id", "hash", "text").mapInArrow(run, "id long, hash long, place long, name long, cls long")
    batch = F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")
    return written(found.withColumn("batch", batch), "entries", BATCH_ROWS)


class LevelFamily:
    """Sorted levels of suffix names with sizes like the digits of a binary counter.

    ``add`` scans a batch against every level and merges it with the levels of equal size, in one aggregation.
    """

    def __init__(self) -> None:
        self.levels: dict[int, DataFrame] = {}

    def add(self, names: DataFrame) -> None:
        rank = 0
        while rank in self.levels:
            rank += 1
        # one sum per name: occurrences in the batch, then 7 bits each for levels that merge, that stay, that marked it
        merges, stays, marked = (1 << 40), (1 << 47), (1 << 54)
        rows = names.select("name", F.lit(1).cast("long").alias("tag"))
        for k, level in self.levels.items():
            tag = F.lit(merges if k < rank else stays) + F.when(F.col("again"), F.lit(marked)).otherwise(F.lit(0))
            rows = rows.unionByName(level.select("name", tag.cast("long").alias("tag")))
        met = rows.groupBy("name").agg(F.sum("tag").alias("tag"))
        n = F.col("tag").bitwiseAND(F.lit(merges - 1))
        older = F.shiftright("tag", 40) > 0
        level = met.filter((n > 0) | (F.shiftright("tag", 40).bitwiseAND(F.lit(127)) > 0)).select(
            "name", ((F.col("tag") >= marked) | (n > 1) | ((n > 0) & older)).alias("again"))
        level = written(level.sortWithinPartitions("name"), "level")
        dropped(*[self.levels.pop(k) for k in range(rank)])
        self.levels[rank] = level

    def repeated(self) -> DataFrame:
        """Names that occur at least twice in all that was added."""
        out = None
        for level in self.levels.values():
            some = level.filter("again").select("name")
            out = some if out is None else out.unionByName(some)
        return out

    def drop(self) -> None:
        dropped(*self.levels.values())


def _cover(n: int, lows: np.ndarray, highs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged byte spans covered by the windows that start at ``lows`` to ``highs``."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, lows, 1)
    np.add.at(step, highs + length, -1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(step[:-1]) > 0).astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _kept(text: bytes, begins: np.ndarray, ends: np.ndarray) -> bytes:
    cuts = zip([0, *ends.tolist()], [*begins.tolist(), len(text)])
    return b"".join(text[a:b] for a, b in cuts) if len(begins) else text


def remove_repeats(docs: DataFrame, length: int = 200, batches: int = 4, with_text: bool = False,
                   carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, text_hash, n_bytes, n_removed, n_spans, kept_sha256`` of each row.

    Every byte is removed that lies in a string of ``length`` bytes that also starts elsewhere in the input. With
    ``with_text``, ``kept`` is the text that is left (parts of cut characters go as well); ``carry`` are further columns
    of ``docs`` to return.
    """
    if not 2 * GRAM <= length <= 1 << 16:
        raise ValueError(f"length must be {2 * GRAM} to {1 << 16} bytes")
    spark = docs.sparkSession
    found = all_entries(docs, length, batches)
    family = LevelFamily()
    for b in range(batches):
        family.add(found.filter(F.col("batch") == b).select("name"))
        released(spark)
    # written, so that both sides of the join are dealt out plainly and a hot name can be split
    names = written(family.repeated().distinct(), "names")
    some = written(found.join(sorted_join(names), "name", "left_semi").drop("batch"), "candidates")
    family.drop()
    dropped(names)
    dropped(found)
    released(spark)

    classes = written(some.groupBy("name", "cls").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("id", "hash", "place")]),
                      "classes")
    # written, so that the joins on a name with very many classes can be split
    mixed = written(classes.groupBy("name").agg(F.count("*").alias("k")).filter("k > 1").select("name"), "mixed")
    split = classes.join(mixed, "name", "left_semi")  # one entry of each class, where classes of a name differ
    whole = some.join(sorted_join(classes.filter("n > 1").select("name", "cls")), ["name", "cls"], "left_semi")
    # per text: repeated runs of windows, and runs that have to be looked into
    low, span = F.shiftright("place", _SPAN), F.col("place").bitwiseAND(F.lit((1 << _SPAN) - 1))
    runs = whole.select("id", "hash", F.struct(low.alias("low"), span.alias("span"), F.lit(None).cast("long").alias("name"),
                                               F.lit(False).alias("alone")).alias("run"))
    runs = runs.unionByName(split.select("id", "hash", F.struct(low.alias("low"), span.alias("span"), "name",
                                                                (F.col("n") == 1).alias("alone")).alias("run")))
    first = written(_pass(_keyed(docs, carry), runs, length, "parts", with_text), "texts", BATCH_ROWS)
    dropped(some, classes, mixed)
    released(spark)
    second = written(_pass(first, _shared(first), length, "windows", with_text), "texts", BATCH_ROWS)
    released(spark)
    third = written(_pass(second, _shared(second).filter("run.alone"), length, None, with_text), "texts", BATCH_ROWS)
    released(spark)
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    columns += [F.col("kept").cast("string").alias("kept")] * with_text + [F.col(f"row._{c}").alias(c) for c in carry]
    ready = first.filter("text IS NULL").unionByName(second.filter("text IS NULL")).unionByName(third)
    return ready.select("row.doc_id", F.col("hash").alias("text_hash"), *columns)


def _shared(texts: DataFrame) -> DataFrame:
    """``id, hash, run`` of the found strings that two classes of a name share."""
    found = texts.filter("text IS NOT NULL").select("id", "hash", F.explode("found").alias("x")).select("id", "hash", "x.*")
    twice = found.groupBy("name", "w").agg(F.count("*").alias("n")).filter("n > 1").select("name", "w")
    return found.join(sorted_join(twice), ["name", "w"], "left_semi").select(
        "id", "hash", F.struct("low", "span", "name", "alone").alias("run"))


_FOUND = "array<struct<name:long,w:long,low:long,span:long,alone:boolean>>"
_MADE = (f"text binary, lows array<long>, highs array<long>, found {_FOUND}, n_bytes long, n_removed long, n_spans long, "
         "kept_sha256 string, kept binary")


def _pass(texts: DataFrame, runs: DataFrame, length: int, look_for: str | None, with_text: bool) -> DataFrame:
    """Meet each text with its runs, and finish it unless runs are to be looked into.

    Runs with a name are looked into for ``look_for``: "parts" (strings that all windows of a quarter of the run hold)
    or "windows"; without ``look_for`` all runs are repeated. What was found goes on with the text.
    """
    # a set: rows that repeat as a whole have the same runs, which count once; so a text has at most as many as places
    runs = runs.groupBy("id", "hash").agg(F.collect_set("run").alias("runs"))
    carried = [c for c in ("lows", "highs") if c in texts.columns]
    if carried:
        texts = texts.filter("text IS NOT NULL")
    texts = texts.select("id", "hash", "row", "text", *carried).join(runs, ["id", "hash"], "left")
    texts = texts.select("id", "hash", "row", "text", "runs", *carried)
    shape = pa.struct([("name", pa.int64()), ("w", pa.int64()), ("low", pa.int64()), ("span", pa.int64()), ("alone", pa.bool_())])
    longs, count = pa.list_(pa.int64()), pa.int64()
    made = [("text", pa.binary()), ("lows", longs), ("highs", longs), ("found", pa.list_(shape)), ("n_bytes", count),
            ("n_removed", count), ("n_spans", count), ("kept_sha256", pa.string()), ("kept", pa.binary())]
    none = np.zeros(0, np.int64)

    def one(rows: pa.RecordBatch, i: int) -> tuple:
        text = rows.column(3)[i].as_py()
        lows, highs = (rows.column(c)[i].values.to_numpy() for c in (5, 6)) if carried else (none, none)
        runs = rows.column(4)[i].values
        if runs is not None:
            low, span, name, alone = (runs.field(k) for k in range(4))
            known = name.is_null().to_numpy(zero_copy_only=False) if look_for else np.ones(len(name), bool)
            low, span = low.to_numpy(), span.to_numpy()
            lows, highs = np.concatenate([lows, low[known]]), np.concatenate([highs, (low + span)[known]])
            if not known.all():
                name, alone = name.fill_null(0).to_numpy(), alone.to_numpy(zero_copy_only=False)
                found = _listed(text, *(x[~known] for x in (low, span, name, alone)), length, look_for)
                return text, lows, highs, found, None, None, None, None, None
        begins, ends = _cover(len(text), lows, highs, length)
        kept = _kept(text, begins, ends)
        whole = kept.decode("utf-8", "ignore").encode() if with_text and len(begins) else kept
        return (None, None, None, None, len(text), int((ends - begins).sum()), len(begins), hashlib.sha256(kept).hexdigest(),
                whole if with_text else None)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = zip(*(one(part, i) for i in range(part.num_rows)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(3)), *(pa.array(c, t) for c, (_, t) in zip(out, made))],
                                                 names=["id", "hash", "row", *(n for n, _ in made)])

    row = texts.schema["row"].dataType.simpleString()
    return texts.mapInArrow(run, f"id long, hash long, row {row}, {_MADE}")


def _listed(text: bytes, low: np.ndarray, span: np.ndarray, name: np.ndarray, alone: np.ndarray, length: int,
            look_for: str) -> list[dict]:
    """``name, w, low, span, alone`` of each window of these runs, or of each part of a run.

    Around the gram of a run, a window reaches ``a`` bytes to the left, 0 to ``length - 64``. Windows are parted by
    ``a`` into quarters; all windows of a quarter hold one string of ``length`` minus a quarter, which ``w`` names.
    """
    out = []
    for at in range(0, len(low), 1024):
        some = [text[a:a + s + length] for a, s in zip(low[at:at + 1024].tolist(), span[at:at + 1024].tolist())]
        where, size = low[at:at + 1024], span[at:at + 1024]
        labels, single = name[at:at + 1024], alone[at:at + 1024]
        lengths = np.array([len(p) for p in some])
        begins = np.cumsum(lengths) - lengths
        gram = _grams(np.frombuffer(b"".join(some), np.uint8))
        if look_for == "windows":
            n = size + 1
            run = np.repeat(np.arange(len(some)), n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = _window(gram, begins[run] + inner, length)
            first, count = where[run] + inner, np.zeros(len(run), np.int64)
        else:
            reach = length - GRAM
            step = reach // 4
            runs, firsts, counts, strings = [], [], [], []
            for r, b in enumerate(begins.tolist()):
                here = gram[b:b + reach + 1].view(np.int64)
                place = int(np.flatnonzero(here == labels[r])[0])  # of the gram, counted from the first window
                upper = place
                for j in range(5):
                    left = min(j * step, reach - step)
                    a, z = max(0, place - left - step), min(int(size[r]), upper)
                    if a <= z and upper >= a:
                        runs.append(r)
                        firsts.append(a)
                        counts.append(z - a)
                        strings.append(b + place - left)
                        upper = a - 1
                    elif place - left - step <= upper:
                        upper = min(upper, place - left - step - 1)
            run, first, count = (np.array(x, dtype=np.int64) for x in (runs, firsts, counts))
            w = _window(gram, np.array(strings, dtype=np.int64), length - step)
            first = first + where[run]
        out.extend(zip(labels[run].tolist(), w.view(np.int64).tolist(), first.tolist(), count.tolist(), single[run].tolist()))
    return [dict(zip(("name", "w", "low", "span", "alone"), x)) for x in out]
