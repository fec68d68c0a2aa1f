"""Joins and unions of half-open intervals within a document.

Overlaps are found by dealing intervals into buckets of ``width`` positions:
an equi-join on (document, bucket) instead of all pairs of a document, so that
one very long document is spread over many tasks.  A pair that shares several
buckets is taken in the first shared one only, which needs no distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordat.operators import scans

WIDTH = 512


def _dealt(spans: DataFrame, start: str, end: str, width: int) -> DataFrame:
    return spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / width))))


def overlap_join(left: DataFrame, right: DataFrame, on: str = "doc_id", width: int = WIDTH, how: str = "inner") -> DataFrame:
    """J-05, J-06: rows of ``left`` (on, start, end, ...) with rows of ``right`` (on, r_start, r_end, ...) that overlap them.

    ``how`` is inner, left_semi or left_anti.  Empty intervals overlap nothing.
    """
    a, b = _dealt(left, "start", "end", width), _dealt(right, "r_start", "r_end", width)
    b = b.withColumnRenamed(on, "_on")
    first = F.col("_bucket") == F.floor(F.greatest("start", "r_start") / width)
    met = (F.col(on) == F.col("_on")) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")) & (F.col("start") < F.col("end")) & (F.col("r_start") < F.col("r_end"))
    joined = a.withColumnRenamed("_bucket", "_own").join(b, (F.col("_own") == F.col("_bucket")) & met)
    pairs = joined.where(first).drop("_bucket", "_own", "_on")
    if how == "inner":
        return pairs
    keys = [on, "start", "end"]
    return left.join(pairs.select(*keys).distinct(), keys, how)


def contained_in(left: DataFrame, right: DataFrame, on: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """J-07: pairs where the left interval lies inside the right one."""
    return overlap_join(left, right, on, width).where("r_start <= start and end <= r_end")


def innermost(pairs: DataFrame, on: str = "doc_id") -> DataFrame:
    """W-12: for each left interval the shortest containing one, the earlier at a tie."""
    w = Window.partitionBy(on, "start", "end").orderBy(F.col("r_end") - F.col("r_start"), "r_start")
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def union(spans: DataFrame, on: str = "doc_id") -> DataFrame:
    """W-11: overlapping and touching intervals merged, by gaps and islands.

    Equal intervals count once: of two, only the first in an order has a gap
    before it, and the two passes may not order them alike.
    Both running values, the farthest end so far and the number of islands, are
    segmented scans, so a document may have any number of intervals.
    """
    runs = scans.Runs(spans.select(on, "start", "end").distinct(), [on], ["start", "end"]).running(inclusive=False, _before=("max", F.col("end")))
    new = F.when(F.col("_before").isNull() | (F.col("start") > F.col("_before")), 1).otherwise(0).cast("long")
    return runs.running(_island=("sum", new)).result().groupBy(on, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def positions_match(left: DataFrame, right: DataFrame, across: float = 1.2, down: float = 2.0) -> DataFrame:
    """J-23: (left_id, n, right_id): gold positions on the same page within the tolerances; right_id only if there is exactly one.

    Both sides have id, page, x0, x1, y0, y1.  Positions are bucketed by the
    vertical middle, so a page with many tokens is no cross join.
    """
    cell = F.floor((F.col("y0") + F.col("y1")) / 2 / down)
    a = left.select(F.col("id").alias("left_id"), "page", F.col("x0").alias("a0"), F.col("x1").alias("a1"), ((F.col("y0") + F.col("y1")) / 2).alias("ay"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    b = right.select(F.col("id").alias("right_id"), "page", F.col("x0").alias("b0"), F.col("x1").alias("b1"), ((F.col("y0") + F.col("y1")) / 2).alias("by"), cell.alias("cell"))
    near = a.join(b, ["page", "cell"]).where((F.abs(F.col("a0") - F.col("b0")) <= across) & (F.abs(F.col("a1") - F.col("b1")) <= across) & (F.abs(F.col("ay") - F.col("by")) <= down))
    n = near.groupBy("left_id").agg(F.count(F.lit(1)).alias("n"), F.min("right_id").alias("right_id"))
    return left.select(F.col("id").alias("left_id")).join(n, "left_id", "left").select("left_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("right_id")).alias("right_id"))


def boxes_holding(tokens: DataFrame, boxes: DataFrame) -> DataFrame:
    """J-24: tokens (token_id, page, x0, y0, x1, y1, text) with boxes (box_id, page, bx0, by0, bx1, by1, box_text) that enclose them and hold the same token text."""
    same = F.array_contains(F.regexp_extract_all("box_text", F.lit(r"[\p{L}\p{N}.,+−-]+"), F.lit(0)), F.col("text"))
    return tokens.join(boxes, "page").where("bx0 <= x0 and x1 <= bx1 and by0 <= y0 and y1 <= by1").where(same).select("token_id", "box_id")
