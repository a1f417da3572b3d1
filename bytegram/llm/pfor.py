"""Token ids in patched frame-of-reference blocks.

Documents are sorted by id, encoded, and their ids (each document ends with ``end_id``) run on without gaps through
containers. A container holds whole documents, their ids and lengths too, so that it can be read by itself, and is one
binary value of a Parquet row, so that every store that Spark reads can hold it. Little-endian layout of a container::

    "PFR1"  u16 block length  u64 number of ids  u32 number of blocks  u32 number of documents
    i64 id of each document  u8 each: 1 if it has an id  u32 each: number of its ids
    u32 start of each block, and the end of the last one, counted from the end of this index
    blocks: u32 minimum  u8 width  u16 number of exceptions
            block length * width bits   (id - minimum, its low ``width`` bits, first id in the highest bits)
            u8 positions of the exceptions, u32 their whole values (id - minimum)

The width is the percentile of the bits that the block's ids need; ids that need more are exceptions. The last block is
filled up with its minimum. Null texts are empty, null document ids come first, repeated rows are kept, documents with
equal ids stand in the order of a hash of their text. An empty table gives an empty table.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytegram.llm.tokens import encoder, grouped

BLOCK = 256
#: A container ends with the document that brings it to this many ids.
CONTAINER_IDS = 1 << 19
_HEAD, _BLOCK = struct.Struct("<4sHQII"), struct.Struct("<IBH")
_BITS = np.left_shift(np.uint64(1), np.arange(33, dtype=np.uint64))  # a value under _BITS[w] fits in w bits


def pack(ids: np.ndarray, percentile: float = 90.0, names: list[int | None] | None = None,
         lengths: list[int] | None = None) -> bytes:
    """One container of these ids, of the documents ``names`` with so many ids each (default: no documents)."""
    names = names or []
    documents = b"".join((np.array([x or 0 for x in names], "<i8").tobytes(),
                          np.array([x is not None for x in names], "u1").tobytes(), np.array(lengths or [], "<u4").tobytes()))
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, dtype=np.uint32)
    grid[:n] = ids
    grid[n:] = ids[(blocks - 1) * BLOCK:].min() if n else 0
    grid = grid.reshape(blocks, BLOCK)
    least = grid.min(axis=1, initial=np.uint32(2**32 - 1)) if blocks else np.zeros(0, np.uint32)
    rest = grid - least[:, None]
    need = np.searchsorted(_BITS, rest.astype(np.uint64), side="right").astype(np.uint8)
    rank = min(BLOCK - 1, max(0, int(np.ceil(percentile / 100 * BLOCK)) - 1))
    width = np.sort(need, axis=1)[:, rank] if blocks else np.zeros(0, np.uint8)
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        bits = (rest[at][:, :, None] >> np.arange(int(w) - 1, -1, -1, dtype=np.uint32)) & np.uint32(1)
        rows = np.packbits(bits.astype(np.uint8).reshape(len(at), -1), axis=1)
        for i, row in zip(at.tolist(), rows):
            packed[i] = row.tobytes()
    row, place = np.nonzero(need > width[:, None])
    cut = np.searchsorted(row, np.arange(blocks + 1))
    place, value = place.astype(np.uint8), rest[row, place].astype("<u4")
    body = []
    for i, (m, w, a, b) in enumerate(zip(least.tolist(), width.tolist(), cut[:-1].tolist(), cut[1:].tolist())):
        body.append(b"".join((_BLOCK.pack(m, w, b - a), packed[i], place[a:b].tobytes(), value[a:b].tobytes())))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in body])]).astype("<u4")
    return b"".join((_HEAD.pack(b"PFR1", BLOCK, n, blocks, len(names)), documents, starts.tobytes(), *body))


def contents(data: bytes) -> tuple[list[int | None], np.ndarray]:
    """The documents of a container, and how many ids each has."""
    documents, at = _HEAD.unpack_from(data)[4], _HEAD.size
    names = np.frombuffer(data, "<i8", documents, at).tolist()
    known = np.frombuffer(data, "u1", documents, at + 8 * documents).tolist()
    return [x if k else None for x, k in zip(names, known)], np.frombuffer(data, "<u4", documents, at + 9 * documents).astype(np.int64)


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids ``first`` to ``last`` (exclusive) of a container; only the blocks that hold them are decoded."""
    magic, block, n, blocks, documents = _HEAD.unpack_from(data)
    if magic != b"PFR1":
        raise ValueError("not a container of token ids")
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, dtype="<u4")
    index = _HEAD.size + 13 * documents
    starts = np.frombuffer(data, "<u4", blocks + 1, index)
    base = index + 4 * (blocks + 1)
    low, high = first // block, -(-last // block)
    out = np.empty(((high - low), block), dtype=np.uint32)
    by_width: dict[int, list[tuple[int, int]]] = {}
    for i in range(low, high):
        at = base + int(starts[i])
        least, width, patches = _BLOCK.unpack_from(data, at)
        by_width.setdefault(width, []).append((i, at + _BLOCK.size))
    for width, where in by_width.items():
        nbytes = block * width // 8
        rows = np.array([i - low for i, _ in where])
        if width == 0:
            out[rows] = 0
            continue
        raw = np.frombuffer(b"".join(data[a:a + nbytes] for _, a in where), np.uint8).reshape(len(where), nbytes)
        bits = np.unpackbits(raw, axis=1).reshape(len(where), block, width)
        value = np.zeros((len(where), block), dtype=np.uint32)
        for k in range(width):
            value = (value << np.uint32(1)) | bits[:, :, k]
        out[rows] = value
    for i in range(low, high):
        at = base + int(starts[i])
        least, width, patches = _BLOCK.unpack_from(data, at)
        if patches:
            at += _BLOCK.size + block * width // 8
            out[i - low, np.frombuffer(data, np.uint8, patches, at)] = np.frombuffer(data, "<u4", patches, at + patches)
        out[i - low] += np.uint32(least)
    return out.reshape(-1)[first - low * block:last - low * block].astype("<u4")


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, keep_space: bool, end_id: int,
                    percentile: float = 90.0) -> None:
    """Encode ``doc_id, text`` and write the containers, in ascending ``doc_id`` order, to ``path``."""
    end = np.array([end_id], dtype="<u4")
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("container", pa.binary())])

    def containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(tokenizer, keep_space), TaskContext.get().partitionId(), 0
        held, names, size = [], [], 0

        def made() -> pa.RecordBatch:
            data = pack(np.concatenate(held), percentile, names, [len(x) + 1 for x in held[::2]])
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, seq, size, data), schema.types)], schema=schema)

        for batch in batches:
            for i, j in grouped(batch.column(1)):
                for name, ids in zip(batch.column(0).slice(i, j - i).to_pylist(),
                                     enc.encode(batch.column(1).slice(i, j - i))):
                    held += [ids, end]
                    names.append(name)
                    size += len(ids) + 1
                    if size >= CONTAINER_IDS:
                        yield made()
                        held, names, size, seq = [], [], 0, seq + 1
        if held:
            yield made()

    # the rows' numbers as last key keep a hot id, or a hot row without one, from being one range
    dealt = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.monotonically_increasing_id().alias("salt"))
             .repartitionByRange("doc_id", F.xxhash64("text"), "salt").sortWithinPartitions("doc_id", F.xxhash64("text")))
    dealt.select("doc_id", "text").mapInArrow(containers, "part int, seq int, n_ids long, container binary").write.parquet(path)


def _bases(files: DataFrame) -> DataFrame:
    """``part, seq, base``: the ids before each container, by sums over parts (a row each), then inside a part."""
    sizes = files.groupBy("part", "seq").agg(F.sum("n_ids").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", "seq", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("seq_start"))
    return sizes.join(parts, "part").select("part", "seq", (F.col("seq_start") + F.col("part_start")).alias("base"))


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """``start, ids`` of the stream of all ids from ``first`` to ``last`` (exclusive), a row for each container it meets.

    Other containers are not read: their places come from the narrow columns. Of a container that the range enters or
    leaves, only the blocks inside are decoded, by its index of block starts.
    """
    files = spark.read.parquet(path)
    places = files.select("part", "seq", "n_ids").join(_bases(files), ["part", "seq"])
    met = places.filter((F.col("base") < last) & (F.col("base") + F.col("n_ids") > first)).select("part", "seq", "base")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                base, data = (batch.column(c)[r].as_py() for c in range(2))
                begin = max(0, first - base)
                yield pa.RecordBatch.from_arrays([pa.array([base + begin]), pa.array(
                    [unpack(data, begin, last - base).astype(np.int64)], pa.list_(pa.int64()))], names=["start", "ids"])

    return files.join(met, ["part", "seq"]).select("base", "container").mapInArrow(cut, "start long, ids array<long>")


def read_token_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens`` and the ``ids`` (or with ``digest`` their ``ids_crc32``) of each document.

    ``start`` counts the ids of all documents before it: sums over parts (one row for each part), then over the
    containers of a part, then inside the container.
    """
    files = spark.read.parquet(path)
    bases = _bases(files)
    last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int64()))
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("inner", pa.int64()),
                        ("n_tokens", pa.int64()), last])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part, seq, data = (batch.column(c)[r].as_py() for c in range(3))
                names, lengths = contents(data)
                ids = unpack(data)
                ends = np.cumsum(lengths)
                begin = ends - lengths
                some = [ids[a:b] for a, b in zip(begin.tolist(), ends.tolist())]
                some = [zlib.crc32(x.tobytes()) for x in some] if digest else [x.tolist() for x in some]
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(names, pa.int64()),
                     pa.array(begin, pa.int64()), pa.array(lengths, pa.int64()), pa.array(some, schema.types[-1])],
                    schema=schema)

    kind = "ids_crc32 long" if digest else "ids array<long>"
    rows = files.select("part", "seq", "container").mapInArrow(
        documents, f"part int, seq int, doc_id long, inner long, n_tokens long, {kind}")
    return rows.join(bases, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", last[0])
