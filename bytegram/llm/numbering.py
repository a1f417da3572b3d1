"""Places of rows in a global order, without a window over all rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytegram.llm.common import written


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str,
             facts: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` with ``pos``, their place from 0 in their ``group`` by ``order``.

    Rows are dealt out by ranges of group and order, sorted, and written with their part and place in it; the row number
    at the head of their last range key keeps many equal rows from being one range. A row for each part and group (that
    is, at most parts plus groups) then has the place of the part's first row. Columns of ``facts``, a row for each
    group, are joined to these rows, and come to ``df``'s rows by a key that never has more rows than one part.
    Rows that are equal in ``order`` stand in any order. Null groups are groups.
    """
    parts = [F.col(c).asc_nulls_first() for c in group]
    salt = F.monotonically_increasing_id()
    rows = written(df.withColumn("_salt", salt).repartitionByRange(*parts, *order, "_salt")
                   .sortWithinPartitions(*parts, *order).drop("_salt")
                   .withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), name)
    heads = rows.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_row").alias("_head"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if facts is not None:
        heads = _joined(heads, facts, group)
    return (_joined(rows, heads, ["_part", *group])
            .withColumn("pos", F.col("_base") + F.col("_row") - F.col("_head")).drop("_part", "_row", "_head", "_base"))


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on columns that may be null."""
    right = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = [left[c].eqNullSafe(right[f"_on_{c}"]) for c in on]
    return left.join(right, same).drop(*[f"_on_{c}" for c in on])
