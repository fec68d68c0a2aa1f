"""Canonical digests of sets of rows: the same for the same rows in any order and partitioning, and hard to meet by other rows.

Rows are hashed with SHA-256, equal ones counted, and the counted hashes laid
out in the order of their text as the leaves of a tree: ranges of hashes with a
common prefix are hashed in order, and these hashes again, until one is left.
How long the prefixes are follows from the number of different rows alone, so
no node has more than some thousands of children, however large the group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.operators.scratch import Scratch

#: Children of a node, on average at most, and the hex digits by which a level is shorter than the one below.
CHILDREN, DIGITS = 4096, 3


def merkle(rows: DataFrame, by: list[str], mark: str, sizes: DataFrame | None = None) -> DataFrame:
    """(by, n, digest): the digest of each group's multiset of ``mark``, a SHA-256 in hex that is null nowhere.

    The groups are as few as declarations; ``sizes`` (by, n) has their numbers of
    rows, if these are known.  The depth of a tree follows from its different
    rows, which are only known once they are counted.  So it is taken from all
    rows first, which is seldom deeper; the few thousand nodes above the leaves
    are saved with what they hold, and where that gives another depth, the
    group's are made once more.
    """
    scratch = Scratch(rows.sparkSession, "digests")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")) if sizes is None else sizes
    nodes = scratch.save(_lowest(rows, by, mark, sizes.select(*by, _digits("n"))), "nodes")
    held = nodes.groupBy(*by, "digits").agg(F.sum("n").alias("n"), F.sum("different").alias("different")).withColumn("right", _digits("different"))
    held = scratch.save(held, "sizes")
    other = held.where("digits <> right")
    if not other.isEmpty():
        again = _lowest(rows, by, mark, other.select(*by, F.col("right").alias("digits")))
        nodes = scratch.save(nodes.join(F.broadcast(other.select(*by)), by, "left_anti").unionByName(again), "right")
    nodes = nodes.drop("n").join(F.broadcast(held.select(*by, "n")), by).select(*by, "n", "digits", "prefix", "node")
    # The deepest tree decides how many levels there are.  A group comes in above its own depth, with the nodes that hold its leaves.
    deepest = held.agg(F.coalesce(F.max("right"), F.lit(0))).first()[0]
    for level in [k for k in range(deepest - 1, -1, -1) if k % DIGITS == 0]:
        # A tree has nodes at its own depth, at every multiple of DIGITS above that, and at the root.
        here = F.col("digits") > level
        joined = nodes.where(here).groupBy(*by, "n", "digits", F.substring("prefix", F.lit(1), F.lit(level)).alias("up"))
        above = joined.agg(_node(F.concat_ws(":", "prefix", "node")).alias("node")).withColumnRenamed("up", "prefix")
        nodes = above.unionByName(nodes.where(~here))
    return nodes.select(*by, "n", F.col("node").alias("digest"))


def _digits(column: str) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log2(F.col(column) / CHILDREN) / 4)).cast("int").alias("digits")


def _node(child: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(F.collect_list(child)), ","), 256)


def _lowest(rows: DataFrame, by: list[str], mark: str, depths: DataFrame) -> DataFrame:
    """(by, digits, prefix, node, n, different) of the nodes that hold the leaves of each group in ``depths`` (by, digits)."""
    # Hashes go as bytes, half of their text; equal ones are counted before they are dealt by node.
    keyed = rows.join(F.broadcast(depths), by).select(*by, "digits", F.unhex(mark).alias("mark"))
    counted = keyed.groupBy(*by, "digits", "mark").agg(F.count(F.lit(1)).alias("times"))
    text = F.lower(F.hex("mark"))
    dealt = counted.withColumn("prefix", F.substring(text, F.lit(1), F.col("digits"))).repartition(*by, "prefix")
    leaves = dealt.select(*by, "digits", "prefix", "times", F.concat_ws(":", text, F.col("times").cast("string")).alias("leaf"))
    return leaves.groupBy(*by, "digits", "prefix").agg(_node(F.col("leaf")).alias("node"), F.sum("times").alias("n"), F.count(F.lit(1)).alias("different"))
