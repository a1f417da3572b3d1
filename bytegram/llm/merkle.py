"""Merkle manifest of a table: hash trees of its rows, and a proof for each row by a recursive query.

A row's leaf is the hash of its columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. The leaves
of one group, in ascending id order, are joined by runs of ``fan`` consecutive nodes, level by level, until one node is
left, the group's subroot; the subroots, ordered by group (null first), are joined likewise to the root.

Every level is written as node rows: place (``tree, level, pos``), the digests of the children (``run``), their hash,
and the place of the parent (``up_tree, up_level, up_pos``) with the slot there; the tree of the subroots has number -1.
``WITH RECURSIVE`` climbs these rows from each leaf to the root: a step joins the parent, puts the digest reached so far
in its slot of the parent's run and hashes the run again, and appends the other digests of the run to the proof. A row
of the climb holds the leaves of one lowest run, which share all siblings above it; each leaf is folded by itself.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytegram.llm.common import only, written
from bytegram.llm.numbering import numbered

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FAN = 8
_TOP = -1


def encoded(columns: Sequence[Column]) -> Column:
    """The columns' values in one string from which each can be read back."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def digest(text: Column) -> Column:
    """SHA-256 of a string, as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def shown(binary: Column) -> Column:
    """Bytes as lower-case hex text: that of a run is that of its digests, one after the other."""
    return F.lower(F.hex(binary))


def leaves(docs: DataFrame, columns: Sequence[str], id_column: str, group: str, tampered: Column, text: str) -> DataFrame:
    """``id, grp, leaf, now``: the hash of each row, and that of the row with ``tampered`` in place of ``text``."""
    hashed = digest(encoded([F.col(c) for c in columns]))
    other = digest(encoded([tampered if c == text else F.col(c) for c in columns]))
    same = tampered.eqNullSafe(F.col(text))
    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(group).cast("string").alias("grp"),
                       hashed.alias("leaf"), F.when(same, F.lit(None)).otherwise(other).alias("now"))


def _links(nodes: DataFrame, fan: int, trees: int) -> DataFrame:
    """Node rows with the place of their parent: inside the tree, from a subroot in the top tree, or none."""
    inner, top = F.col("n") > 1, (F.col("tree") != _TOP) & F.lit(trees > 1)
    return nodes.select(
        "tree", "level", "pos", "n", "run", "hash", *[c for c in nodes.columns if c == "leaves"],
        F.when(inner, F.col("tree")).when(top, F.lit(_TOP)).cast("long").alias("up_tree"),
        F.when(inner, F.col("level") + 1).when(top, F.lit(1)).cast("int").alias("up_level"),
        F.floor(F.when(inner, F.col("pos")).when(top, F.col("tree")) / fan).alias("up_pos"),
        (F.when(inner, F.col("pos")).when(top, F.col("tree")) % fan).cast("int").alias("slot"))


def _next_level(level: DataFrame, fan: int, trees: int) -> DataFrame:
    """The parents of all nodes of a level whose tree has several there."""
    run = F.transform(F.array_sort(F.collect_list(F.struct("slot", "hash"))), lambda x: x["hash"])
    parents = (level.filter("n > 1").groupBy("tree", F.col("up_pos").alias("pos"), F.col("up_level").alias("level"))
               .agg(F.unhex(F.array_join(F.transform(run, F.hex), "")).alias("run"), F.first("n").alias("n")))
    parents = parents.withColumn("n", F.ceil(F.col("n") / fan)).withColumn("hash", digest(shown(F.col("run"))))
    return _links(parents, fan, trees)


def build(rows: DataFrame, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Starts of the climb and node rows of all levels above, from ``id, grp, leaf, now``.

    Leaves of equal ids stand in order of their hashes. A level has a ``fan``-th of the nodes of the level below, so the
    number of levels, each a job, is the logarithm of the largest group.
    """
    rows = written(rows, "leaves")
    trees = numbered(rows.groupBy("grp").agg(F.count("*").alias("n")), [], [F.col("grp").asc_nulls_first()], "trees")
    trees = written(trees.withColumnRenamed("pos", "tree"), "trees")
    n_trees, largest = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    placed = numbered(rows, ["grp"], [F.col("id").asc_nulls_first(), F.col("leaf").asc()], "placed", trees)
    struct = F.struct((F.col("pos") % fan).alias("slot"), "id", "leaf", F.coalesce("now", "leaf").alias("now"))
    runs = (placed.groupBy("tree", F.floor(F.col("pos") / fan).alias("pos"))
            .agg(F.array_sort(F.collect_list(struct)).alias("kids"), F.first("n").alias("leaves_n")))
    run = F.unhex(F.array_join(F.transform("kids", lambda x: F.hex(x["leaf"])), ""))
    lone = F.col("leaves_n") == 1  # a lone leaf is its tree's subroot itself
    folded = lambda x: F.when(lone, x["now"]).otherwise(digest(shown(F.concat(
        F.substr("run", F.lit(1), 32 * x["slot"]), x["now"], F.substr("run", 32 * x["slot"] + 33)))))
    starts = runs.withColumn("run", run).select(
        "tree", F.when(lone, 0).otherwise(1).alias("level"), "pos", F.ceil(F.col("leaves_n") / fan).alias("n"), "run",
        F.when(lone, F.col("run")).otherwise(digest(shown(F.col("run")))).alias("hash"),
        F.transform("kids", lambda x: F.struct(x["id"].alias("id"), x["leaf"].alias("leaf"), folded(x).alias("folded")))
        .alias("leaves"))
    starts = written(_links(starts, fan, n_trees), "nodes")
    level, levels, n = starts, [starts.drop("leaves")], -(-largest // fan)
    while n > 1:
        level = written(_next_level(level, fan, n_trees), "nodes")
        levels.append(level)
        n = -(-n // fan)
    nodes = levels[0]
    for other in levels[1:]:
        nodes = nodes.unionByName(other)
    if n_trees > 1:
        tops = nodes.filter("n = 1").select("tree", "hash").select(
            F.lit(_TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("pos"),
            F.lit(n_trees).cast("long").alias("n"), F.lit(None).cast("binary").alias("run"), "hash")
        level, n = _links(tops, fan, n_trees), n_trees
        while n > 1:
            level = written(_next_level(level, fan, n_trees), "nodes")
            nodes = nodes.unionByName(level)
            n = -(-n // fan)
    return starts, nodes


_CLIMB = """
WITH RECURSIVE climb(leaves, above, subroot, hash, up_tree, up_level, up_pos, slot) AS (
  SELECT leaves, CAST('' AS BINARY), CASE WHEN n = 1 THEN hash END, hash, up_tree, up_level, up_pos, slot FROM {starts}
  UNION ALL
  SELECT transform(c.leaves, x -> named_struct('id', x.id, 'leaf', x.leaf, 'folded', unhex(sha2(lower(hex(concat(
             substring(n.run, 1, 32 * c.slot), x.folded, substring(n.run, 32 * c.slot + 33)))), 256)))),
         concat(c.above, substring(n.run, 1, 32 * c.slot), substring(n.run, 32 * c.slot + 33)),
         coalesce(c.subroot, CASE WHEN n.n = 1 THEN n.hash END), n.hash, n.up_tree, n.up_level, n.up_pos, n.slot
  FROM climb c JOIN {nodes} n ON n.tree = c.up_tree AND n.level = c.up_level AND n.pos = c.up_pos)
SELECT leaves, above, subroot, hash AS root FROM climb WHERE up_tree IS NULL"""


def climbed(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, leaf, subroot, root, siblings, folded_root`` of every leaf: the recursive query over the node rows.

    Spark stops a recursive query at a number of rows that it sets; every leaf must arrive here, so that guard is off
    while the query runs. It ends by itself at the root, which has no parent.
    """
    spark, key = starts.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        rows = written(spark.sql(_CLIMB, starts=starts.drop("run"), nodes=nodes.filter("run IS NOT NULL")), "climb")
    finally:
        spark.conf.set(key, before)
    near = F.array_join(F.transform("leaves", lambda x: F.hex(x["leaf"])), "")
    rows = rows.select(F.unhex(near).alias("run"), "above", "subroot", "root", F.posexplode("leaves").alias("slot", "x"))
    cut = 32 * F.col("slot")
    siblings = F.concat(F.substr("run", F.lit(1), cut), F.substr("run", cut + 33), F.col("above"))
    return rows.select(F.col("x.id").alias("id"), F.col("x.leaf").alias("leaf"), "subroot", "root",
                       siblings.alias("siblings"), F.col("x.folded").alias("folded_root"))


def tampered_text(id_column: str = "doc_id", text: str = "text", divisor: int = 3) -> Column:
    """The text, its A-Z lower-cased where ``divisor`` divides the crc32 of the id's decimal text (null id: as it is)."""
    hit = F.crc32(F.col(id_column).cast("string").cast("binary")) % divisor == 0
    return F.when(hit, F.translate(text, UPPER, UPPER.lower())).otherwise(F.col(text))


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
             id_column: str = "doc_id", group: str = "lang", text: str = "text", fan: int = FAN) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs``.

    Null columns count as ``-``, empty ones as ``0:``. Rows without an id stand first in their group and are never
    tampered with; repeated rows have a leaf each. A group of one row has its leaf as subroot, one group alone has its
    subroot as root, and a leaf without siblings the hash of nothing as proof. An empty table gives no row.
    """
    docs = only(docs, dict.fromkeys([*columns, id_column, group, text]))
    rows = leaves(docs, columns, id_column, group, tampered_text(id_column, text), text)
    out = climbed(*build(rows, fan))
    return out.select(F.col("id").alias(id_column), shown(F.col("leaf")).alias("leaf"), shown(F.col("subroot")).alias("subroot"),
                      shown(F.col("root")).alias("root"), F.sha2(shown(F.col("siblings")), 256).alias("proof_sha256"),
                      shown(F.col("folded_root")).alias("folded_root"),
                      (F.col("folded_root") == F.col("root")).alias("verified"))
