"""Closures over declared graphs: metric dependencies, includes and declarations.

Paths are doubled: each round joins what is reached in fewer than 2**t steps
with the pairs of nodes that lie 2**t steps apart, so a chain of n nodes takes
about log2(n) rounds.  Each round's tables are written to the shared folder,
which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.operators.scratch import Scratch


def closure(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """J-18, J-31: (root, node, depth): all nodes reachable from each root over ``edges`` (src, dst), itself included at depth 0.

    ``depth`` is the least number of steps.  Cycles end by themselves: a round
    that reaches nothing new is the last, however long the paths are.
    """
    scratch = Scratch(edges.sparkSession, "closure")
    jumps = scratch.save(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "jumps-0")
    if roots is None:
        roots = edges.select(F.col("src").alias("root")).union(edges.select("dst"))
    reached = scratch.save(roots.select("root").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth")), "reached-0")
    count, turn = reached.count(), 0
    while True:
        # The least depth of a node is a sum of different powers of two, and the parts of a shortest path are walks of these lengths.
        step = reached.join(jumps, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), (F.col("depth") + F.lit(2**turn)).cast("int").alias("depth"))
        reached = scratch.save(reached.unionByName(step).groupBy("root", "node").agg(F.min("depth").alias("depth")), f"reached-{turn + 1}")
        now = reached.count()
        if now == count:
            return reached
        count, turn = now, turn + 1
        a, b = jumps.alias("a"), jumps.alias("b")
        jumps = scratch.save(a.join(b, F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst").distinct(), f"jumps-{turn}")


def cycles(edges: DataFrame) -> DataFrame:
    """S-13: nodes that reach themselves in one or more steps."""
    found = closure(edges.where("src <> dst")).where("depth > 0")
    back = found.join(edges.where("src <> dst"), (F.col("node") == F.col("src")) & (F.col("root") == F.col("dst"))).select(F.col("root").alias("node"))
    return back.union(edges.where("src = dst").select(F.col("src").alias("node"))).distinct()


def leaves(edges: DataFrame) -> DataFrame:
    """(root, leaf): the nodes without outgoing edges that each node reaches; a node without edges is its own leaf."""
    inner = edges.select(F.col("src").alias("node")).distinct()
    return closure(edges).join(inner, "node", "left_anti").select("root", F.col("node").alias("leaf"))


def resolve_includes(documents: DataFrame, pattern: str = r"\\(?:input|include)\{([^}]+)\}") -> DataFrame:
    """S-13: (src, target, dst, error): each include with the one registered file it names, or why there is none.

    ``documents`` has file and text.  A target matches a file as written or
    with ``.tex`` added, relative to the including file's folder or the root.
    """
    used = documents.select(F.col("file").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("target"))
    folder = F.regexp_extract("src", r"^(.*/)[^/]*$", 1)
    tries = F.array_distinct(F.array("target", F.concat("target", F.lit(".tex")), F.concat(folder, "target"), F.concat(folder, "target", F.lit(".tex"))))
    met = used.select("src", "target", F.explode(tries).alias("file")).join(documents.select("file"), "file")
    hits = met.groupBy("src", "target").agg(F.count_distinct("file").alias("n"), F.min("file").alias("dst"))
    out = used.distinct().join(hits, ["src", "target"], "left")
    return out.select("src", "target", F.when(F.col("n") == 1, F.col("dst")).alias("dst"), F.when(F.col("n").isNull(), "MISSING_INCLUDE").when(F.col("n") > 1, "AMBIGUOUS_INCLUDE").alias("error"))
