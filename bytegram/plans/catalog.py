"""Named corpora: a persisted catalog, and one object for the questions that can be put to a corpus.

The catalog is an append-only table of entries; the newest entry of a name counts, and an entry without paths removes
the name. Opening all corpora keeps those apart that fail: one broken path takes no other corpus with it.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..constants import DEFAULT_MAX_CTX_LEN, DEFAULT_MAX_RESULTS, NEGATIVE, SHARD_RANGE
from ..operators import ordered as OD
from ..operators import retrieve as RT
from ..operators.pruning import local
from . import requests as RQ
from .corpus import Corpus

ENTRY = "name string, paths array<string>, index string, keep boolean, get_metadata boolean, at timestamp, number bigint"


@dataclass
class Searchable:
    """A corpus with its sorted suffix table. Arguments are checked before anything runs; wrong ones raise."""

    corpus: Corpus
    index: OD.OrderedIndex

    @cached_property
    def num_shards(self) -> int:
        return len(self.index.shards)

    def _asked(self, q: str) -> DataFrame:
        if not isinstance(q, str):
            raise TypeError(f"query must be str, got {type(q).__name__!r}")
        return local(self.corpus.spark, [(0, q)], ["qid", "query"])

    def find(self, q: str) -> DataFrame:
        """``query, shard, lo, hi``."""
        return OD.find(self.index, self.corpus.layout, self._asked(q)).drop("qid")

    def count(self, q: str) -> DataFrame:
        """``query, count``."""
        return self.find(q).groupBy("query").agg(F.sum(F.col("hi") - F.col("lo")).cast("bigint").alias("count"))

    def search(self, q: str, max_results: int = DEFAULT_MAX_RESULTS, max_ctx_len: int = DEFAULT_MAX_CTX_LEN) -> DataFrame:
        self._asked(q)
        return OD.search(self.index, self.corpus.layout, q, max_results, max_ctx_len, self.corpus.get_metadata)

    def get_doc_by_rank(self, s: int, rank: int, needle_len: int, max_ctx_len: int = DEFAULT_MAX_CTX_LEN) -> DataFrame:
        if not 0 <= s < self.num_shards:
            raise ValueError(SHARD_RANGE.format(s=s, n=self.num_shards))
        if rank < 0:
            raise ValueError(NEGATIVE.format(name="rank", value=rank))
        RT.check_limits(max_ctx_len, needle_len)
        asked = local(self.corpus.spark, [(0, s, rank, needle_len, max_ctx_len)], ["req_id", "s", "rank", "needle_len", "max_ctx_len"])
        return OD.get_doc_by_rank(self.index, self.corpus.layout, asked, self.corpus.get_metadata).drop("req_id")


class Catalog:
    """The named corpora below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entries(self) -> DataFrame:
        """``name, paths, index, keep, get_metadata``: the newest entry of each name."""
        try:
            rows = self.spark.read.schema(ENTRY).parquet(self.path)
        except AnalysisException:
            rows = self.spark.createDataFrame([], ENTRY)
        newest = Window.partitionBy("name").orderBy(F.col("number").desc(), F.col("at").desc())
        rows = rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1 AND paths IS NOT NULL")
        return rows.select("name", "paths", "index", "keep", "get_metadata")

    def _append(self, name: str, paths: list[str] | None, index: str | None, keep: bool, get_metadata: bool) -> None:
        try:
            number = self.spark.read.schema(ENTRY).parquet(self.path).agg(F.max("number")).first()[0] + 1
        except AnalysisException:
            number = 0
        row = self.spark.createDataFrame([(name, paths, index, keep, get_metadata, None, number)], ENTRY)
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)

    def register(self, name: str, paths: list[str] | str, index: str | None = None, keep: bool = False,
                 get_metadata: bool = True) -> None:
        """Name the corpus tables at ``paths`` (several are one corpus), with the suffix table at ``index``. ``keep``: hold
        the opened corpus in the executors' memory and on their disks."""
        paths = [paths] if isinstance(paths, str) else list(paths)
        if not name or not paths:
            raise ValueError("a corpus needs a name and a path")
        self._append(name, paths, index, keep, get_metadata)

    def remove(self, name: str) -> None:
        self._append(name, None, None, False, False)

    def _open(self, entry) -> tuple[Corpus, OD.OrderedIndex | None]:
        corpus = Corpus.open(self.spark, entry["paths"], entry["get_metadata"])
        if entry["keep"]:
            corpus.layout.persist(StorageLevel.MEMORY_AND_DISK)
        return corpus, OD.open_ordered(self.spark, entry["index"], layout=corpus.layout) if entry["index"] else None

    def open(self, name: str) -> Corpus:
        return self._open(self._entry(name))[0]

    def searchable(self, name: str) -> Searchable:
        corpus, index = self._open(self._entry(name))
        if index is None:
            raise ValueError(f"{name} has no suffix table")
        return Searchable(corpus, index)

    def _entry(self, name: str):
        found = self.entries().filter(F.col("name") == name).first()
        if found is None:
            raise KeyError(name)
        return found

    def open_all(self) -> tuple[dict[str, tuple], dict[str, str]]:
        """Corpora and suffix tables by name, and what went wrong by name."""
        good, bad = {}, {}
        for entry in self.entries().orderBy("name").collect():  # a row for each named corpus
            try:
                good[entry["name"]] = self._open(entry)
            except (ValueError, AnalysisException) as e:
                bad[entry["name"]] = str(e)
        return good, bad

    def summary(self) -> DataFrame:
        """``corpus, docs, text_bytes, size`` of every corpus that opens, one scan of narrow columns for each."""
        out = None
        for name, (corpus, _) in self.open_all()[0].items():
            per = corpus.layout.groupBy("shard").agg(F.count(F.lit(1)).alias("docs"), F.sum("doc_len").alias("text_bytes"))
            row = per.agg(F.sum("docs").cast("bigint").alias("docs"), F.sum("text_bytes").cast("bigint").alias("text_bytes"),
                          F.sum(F.col("docs") + F.col("text_bytes") + 1).cast("bigint").alias("size"))
            row = row.select(F.lit(name).alias("corpus"), "docs", "text_bytes", "size")
            out = row if out is None else out.unionByName(row)
        return out if out is not None else self.spark.createDataFrame([], "corpus string, docs bigint, text_bytes bigint, size bigint")

    def views(self, prefix: str = "") -> list[str]:
        """Make every corpus that opens a temporary view; returns the views' names."""
        good, _ = self.open_all()
        for name, (corpus, _) in good.items():
            corpus.layout.createOrReplaceTempView(f"{prefix}{name}")
        return [f"{prefix}{n}" for n in good]

    def dispatch(self, requests: DataFrame) -> DataFrame:
        """Answer a request table from the corpora that open and have a suffix table; others are unknown to it."""
        return RQ.dispatch({n: x for n, x in self.open_all()[0].items() if x[1] is not None}, requests)
