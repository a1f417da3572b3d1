"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Round one runs where the documents lie: each task packs blocks of pieces by best fit (longest first) and emits nearly
full bins. Underfull bins are then items themselves, a row with id and fill each: every later round deals them into
fewer groups of bounded size and packs them again by best fit, until one group is left, or a round saves next to nothing.
What the rounds decided reaches the pieces in one join by bin. A group holds about ``GROUP_BINS`` rows or ``BLOCK_PIECES``
pieces, whatever the input.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegram.llm.common import written
from bytegram.llm.tokens import encoder, grouped

BLOCK_PIECES = 100_000
GROUP_BINS = 20_000
_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin; longest items first, each into the tightest gap."""
    bin_of = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    gaps = 0  # bit r is set while a bin with r places left exists
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = gaps >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                gaps &= ~(1 << r)
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += n
        if r > n:
            free[r - n].append(b)
            gaps |= 1 << (r - n)
    return bin_of, offset, np.array(fill, dtype=np.int64)


def pack_documents(docs: DataFrame, tokenizer: str, keep_space: bool, end_id: int, capacity: int = 2048,
                   nearly_full: float = 0.995) -> DataFrame:
    """Places of all pieces: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is the ids of its whole text (null: empty) and ``end_id``. Only a document over ``capacity`` is cut;
    its first piece takes the remainder, all others are full. Repeated rows and null ids are packed like others.
    """
    enough = int(capacity * nearly_full)

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, keep_space)
        end = np.array([end_id], dtype="<u4")
        base = TaskContext.get().partitionId() << 36
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            nonlocal base, held
            lengths = np.array([h[3] for h in held], dtype=np.int64)
            bin_of, offset, fill = best_fit(lengths, capacity)
            columns = [*zip(*held)]
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32())]
            arrays += [pa.array(c, pa.int64()) for c in (*columns[2:], base + bin_of, offset, fill[bin_of])]
            base, held = base + len(fill), []
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _COLUMNS.split(", ")])

        for batch in batches:
            for i, j in grouped(batch.column(1)):
                names = batch.column(0).slice(i, j - i).to_pylist()
                for name, ids in zip(names, enc.encode(batch.column(1).slice(i, j - i))):
                    ids = np.concatenate([ids, end])
                    cut = len(ids) % capacity or capacity
                    begin = 0
                    for piece in range(-(-len(ids) // capacity)):
                        held.append((name, piece, begin, cut - begin, zlib.crc32(ids[begin:cut].tobytes())))
                        begin, cut = cut, cut + capacity
                    if len(held) >= BLOCK_PIECES:
                        yield packed()
        if held:
            yield packed()

    def next_round(number: int):
        def again(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
            bins = bins.sort_values("bin")
            bin_of, offset, fill = best_fit(bins["fill"].to_numpy(), capacity)
            base = (number << 58) | (int(key[0]) << 36)
            return pd.DataFrame({"was": bins["bin"], "bin": base + bin_of, "shift": offset, "fill": fill[bin_of]})

        return again

    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                   .mapInArrow(first_round, _COLUMNS), "packing")
    under = written(rows.filter(F.col("fill") < enough).groupBy("bin").agg(F.first("fill").alias("fill")), "bins")
    # where each underfull bin of round one lies by now
    moved = under.select(F.col("bin").alias("first"), "bin", F.lit(0).cast("long").alias("shift"))
    number, before = 0, None
    while True:
        bins = under.count()
        if bins <= 1 or before is not None and (before[1] == 1 or bins > 0.98 * before[0]):
            break
        groups = -(-bins // GROUP_BINS)
        before, number = (bins, groups), number + 1
        dealt = under.withColumn("deal", F.pmod(F.xxhash64("bin"), F.lit(groups)))
        made = written(dealt.groupBy("deal").applyInPandas(next_round(number), "was long, bin long, shift long, fill long"), "bins")
        step = made.select("was", F.col("bin").alias("now"), F.col("shift").alias("more"))
        moved = written(moved.join(step, moved["bin"] == step["was"], "left").select(
            "first", F.coalesce("now", "bin").alias("bin"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")), "moved")
        under = made.filter(F.col("fill") < enough).groupBy("bin").agg(F.first("fill").alias("fill"))
    moved = moved.select("first", F.col("bin").alias("now"), "shift")
    return rows.join(moved, rows["bin"] == moved["first"], "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("now", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
