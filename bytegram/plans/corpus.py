"""``Corpus``: the user-facing handle. Builds lazily planned DataFrames; Catalyst does the rest."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import count as _count
from ..operators import layout as _layout
from ..session import shuffles_removed
from ..sources import records as _rec

CORPUS_COLUMNS = ("shard", "doc_ix", "path", "linenum", "text", "metadata", "doc_len",
                  "data_offset", "meta_offset", "shard_bytes", "shard_docs", "shard_first_doc", "bytes")


class Corpus:
    """A corpus of documents in a fixed order, cut into byte-balanced shards.

    ``docs``  : ``doc_ix, path, linenum, text, metadata`` (metadata = JSON envelope, or ``""`` when
                metadata is off).
    ``layout``: ``docs`` plus ``shard, doc_len, data_offset, meta_offset, shard_bytes, …``.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, num_shards: int = 1,
                 layout: DataFrame | None = None, get_metadata: bool = True):
        self.spark = spark
        self.num_shards = num_shards
        self.get_metadata = get_metadata
        if not get_metadata:
            docs = docs.withColumn("metadata", F.lit(""))
        self.docs = docs
        self._layout = layout

    # ---- construction -------------------------------------------------------------------------
    @classmethod
    def from_records(cls, spark: SparkSession, records: DataFrame, num_shards: int = 1,
                     get_metadata: bool = True) -> "Corpus":
        docs = _layout.global_doc_index(records)
        docs = docs.select("doc_ix", "path", "linenum", "text",
                           _rec.metadata_envelope(docs).alias("metadata"))
        return cls(spark, docs, num_shards, get_metadata=get_metadata)

    @classmethod
    def from_files(cls, spark: SparkSession, paths, text_key: str = "text", num_shards: int = 1,
                   get_metadata: bool = True, on_bad: str = "fail", meta_key: str | None = None) -> "Corpus":
        """``meta_key``: a record's metadata are the object in this field, not all other fields (JSON-lines only)."""
        return cls.from_records(spark, _rec.read_records(spark, paths, text_key, on_bad, meta_key), num_shards,
                                get_metadata)

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, text_key: str = "text", num_shards: int = 1,
                     get_metadata: bool = True) -> "Corpus":
        """One Parquet table (a file, a folder or a list) as the corpus; record number = row index in the file. Files that
        are not one table, and so differ in their columns, go through :meth:`from_files`."""
        files = [_rec.qualify(p) for p in ([path] if isinstance(path, str) else list(path))]
        root = _rec.common_folder(min(files), max(files))
        recs = _rec.parquet_records(spark, files, root, text_key, one_table=True)
        return cls.from_records(spark, recs, num_shards, get_metadata)

    @classmethod
    def from_shards(cls, spark: SparkSession, shards: list[list[str]], get_metadata: bool = True) -> "Corpus":
        """Small in-memory corpus with explicit shards (lists of texts), for tests and examples."""
        rows, ix = [], 0
        for s, texts in enumerate(shards):
            for t in texts:
                rows.append((ix, s, "mem", ix, t, '{"path":"mem","linenum":%d,"metadata":{}}' % ix))
                ix += 1
        docs = spark.createDataFrame(rows, "doc_ix long, shard int, path string, linenum long, text string, "
                                           "metadata string")
        lay = _layout.explicit_shards(docs)
        return cls(spark, docs.drop("shard"), len(shards), layout=lay, get_metadata=get_metadata)

    @classmethod
    def open(cls, spark: SparkSession, path: str | list[str], get_metadata: bool = True) -> "Corpus":
        """Open a corpus written by :meth:`write` (shard-partitioned Parquet). Checks the schema.

        Several tables are one corpus: shards and documents of a later one are numbered on after those of the earlier.
        """
        paths = [path] if isinstance(path, str) else list(path)
        lay, shards, documents = None, 0, 0
        for p in paths:
            one = cls._table(spark, p)
            if len(paths) > 1:
                n, docs = one.select("shard", "shard_docs").distinct().agg(F.max("shard") + 1, F.sum("shard_docs")).first()
                one = one.withColumns({"shard": (F.col("shard") + shards).cast("int"), "doc_ix": F.col("doc_ix") + documents,
                                       "shard_first_doc": F.col("shard_first_doc") + documents})
                shards, documents = shards + (n or 0), documents + (docs or 0)
            lay = one if lay is None else lay.unionByName(one)
        if not get_metadata:
            lay = lay.withColumn("metadata", F.lit(""))
        n = lay.select("shard").distinct().count()
        docs = lay.select("doc_ix", "path", "linenum", "text", "metadata")
        return cls(spark, docs, n, layout=lay, get_metadata=get_metadata)

    @staticmethod
    def _table(spark: SparkSession, path: str) -> DataFrame:
        try:
            lay = spark.read.parquet(path)
            cols = lay.columns
        except Exception as e:  # noqa: BLE001 - unreadable or not Parquet
            raise ValueError(f"{path} is not a corpus table: {str(e)[:200]}") from e
        missing = [c for c in CORPUS_COLUMNS if c not in cols]
        if missing:
            raise ValueError(f"{path} is not a corpus table; missing {missing}")
        return lay.select(*CORPUS_COLUMNS)

    # ---- layout -------------------------------------------------------------------------------
    @cached_property
    def layout(self) -> DataFrame:
        """The corpus table. Written once as Parquet below the shared checkpoint folder and read again, so every
        later query scans only the columns, shards and ``doc_ix`` ranges that it needs."""
        if self._layout is not None:
            return self._layout
        from ..session import scratch_path
        lay = _layout.assign_shards(self.docs, self.num_shards)
        path = self._write_table(lay, scratch_path(self.spark, "corpus"), "overwrite", placed=True)
        return self.spark.read.schema(lay.select(*CORPUS_COLUMNS).schema).parquet(path)

    def write(self, path: str, mode: str = "overwrite") -> str:
        """Write the corpus table, one folder per shard (dynamic partition overwrite keeps other shards)."""
        built = self._layout is not None or "layout" in self.__dict__
        return self._write_table(self.layout if built else _layout.assign_shards(self.docs, self.num_shards), path, mode, placed=not built)

    def _write_table(self, layout: DataFrame, path: str, mode: str, placed: bool) -> str:
        # Contiguous document ranges per task: a few sorted files per shard folder, none spanning shards. ``bytes`` repeat the
        # text, and so are added behind shuffle and sort.
        rows = layout.select(*[c for c in CORPUS_COLUMNS if c != "bytes"])
        if not placed:
            n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
            rows = rows.repartitionByRange(n, "shard", "doc_ix")
        with shuffles_removed(self.spark):
            (_layout.with_bytes(rows.sortWithinPartitions("shard", "doc_ix")).select(*CORPUS_COLUMNS)
             .write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
             .partitionBy("shard").parquet(path))
        return path

    def shard(self, shard_id: int) -> DataFrame:
        return self.layout.filter(F.col("shard") == F.lit(shard_id))

    # ---- counting -----------------------------------------------------------------------------
    @property
    def texts(self) -> DataFrame:
        """``doc_ix, text, doc_len, bytes`` from the materialised corpus table."""
        cols = [c for c in ("doc_ix", "text", "doc_len", "bytes") if c in self.layout.columns]
        return self.layout.select(*cols)

    def count(self, q: str) -> DataFrame:
        if q == "":
            return _count.count_empty(self.layout)
        return _count.count_literal(self.texts, q)

    def count_many(self, queries: list[str]) -> DataFrame:
        return _count.count_literals(self.texts, queries)

    def count_by_shard(self, q: str) -> DataFrame:
        return _count.count_by_shard(self.layout, q)

    def count_batch(self, queries: DataFrame, qid: str = "qid", qcol: str = "query") -> DataFrame:
        return _count.count_batch(self.texts, queries, qid, qcol, empty_count=_count.count_empty(self.layout))
