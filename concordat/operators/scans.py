"""Prefix operations and selections by rank over groups of any size.

A window gathers its group in one task.  Here a group may be as large as the
table: ``Runs`` sorts rows into range partitions, sums each partition up, and
gives every partition what came before it; ``quantiles`` narrows each wanted
rank to an interval of few rows and sorts only those.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.operators.scratch import Scratch

#: Rows of a group among which a rank is looked up by sorting.
FEW = 65_536
#: Points of the sketch that narrows an interval.
POINTS = 1_000


class Runs:
    """A two-pass segmented scan of ``rows`` by ``keys``, in the total order ``order`` within them.

    The rows are saved once in range partitions of (keys, order), so both
    passes see the same parts.  A group that spans several parts costs each of
    them one row of offsets; no task holds more than its part.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None):
        self.keys, self.order = keys, order
        self.scratch = Scratch(rows.sparkSession, "runs")
        n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartitionByRange(n, *[F.col(c) for c in (*keys, *order)]).withColumn("_part", F.spark_partition_id())
        self.rows = self.scratch.save(dealt, "rows")

    def running(self, inclusive: bool = True, **columns: tuple[str, Column]) -> Runs:
        """Adds, for each name, the ``sum``, ``max`` or ``last`` (not null) of a column over all rows of the group up to this one, or up to the one before."""
        own = Window.partitionBy("_part", *self.keys).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
        rows = self.rows
        for name, (_, x) in columns.items():
            rows = rows.withColumn(f"_of_{name}", x)

        def whole(how: str, c: str) -> Column:
            return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*self.order))) if how == "last" else over[how](c)

        totals = rows.groupBy("_part", *self.keys).agg(*[whole(how, f"_of_{name}").alias(f"_of_{name}") for name, (how, _) in columns.items()])
        # As many rows of a key as parts that it spans.
        before = Window.partitionBy(*self.keys or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(F.col("_part").alias("_at"), *[F.col(k).alias(f"_key_{k}") for k in self.keys], *[over[how](f"_of_{name}").over(before).alias(f"_before_{name}") for name, (how, _) in columns.items()], F.row_number().over(Window.partitionBy(*self.keys or [F.lit(0)]).orderBy("_part")).alias("_nth"))
        met = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_key_{k}")), self.keys, F.col("_part") == F.col("_at"))
        inside = rows.withColumns({f"_own_{name}": over[how](f"_of_{name}").over(own) for name, (how, _) in columns.items()})
        out = inside.join(offsets.where("_nth > 1").drop("_nth"), met, "left")
        for name, (how, _) in columns.items():
            mine, earlier = F.col(f"_own_{name}"), F.col(f"_before_{name}")
            both = {"sum": F.when(mine.isNull(), earlier).when(earlier.isNull(), mine).otherwise(mine + earlier), "max": F.greatest(mine, earlier), "last": F.coalesce(mine, earlier)}[how]
            out = out.withColumn(name, both)
        new = Runs.__new__(Runs)
        new.keys, new.order, new.scratch = self.keys, self.order, self.scratch
        new.rows = out.select(*self.rows.columns, *columns)
        return new

    def result(self) -> DataFrame:
        return self.rows.drop("_part")


def numbered(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with their place, from 1, in a total order of the whole table."""
    return Runs(rows, [], order).running(**{name: ("sum", F.lit(1).cast("long"))}).result()


def quantiles(values: DataFrame, by: list[str], column: str, points: dict[str, tuple[str, float]], few: int = FEW) -> DataFrame:
    """(by, n, and for each name its quantile) of ``column``; nulls don't count.

    A point is ("nearest", q), the value of rank ceil(q * n), or ("linear", q),
    interpolated between the neighbours of q * (n - 1).  Both are exact.

    Every wanted rank starts with the whole group.  While its interval holds
    more than ``few`` rows and more than one value, a sketch of the rows inside
    proposes two values around the rank, exact counts of the rows below, at,
    between and above them decide which part the rank is in, and only that part
    is looked at again: usually some 300 times fewer rows each round, and fewer
    by two values at least.  The few rows left are counted by value and ranked.
    """
    spark = values.sparkSession
    scratch = Scratch(spark, "quantiles")
    rows = values.select(*by, F.col(column).alias("v")).where("v is not null")
    kind = rows.schema["v"].dataType.simpleString()
    wanted = []
    for name, (how, q) in points.items():
        n = F.col("n")
        if how == "nearest":
            # In whole parts per million, so that 0.95 * 20 is 19 and no bit more.
            wanted.append(F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(n * F.lit(round(q * 1_000_000)).cast("decimal(20,0)") / 1_000_000), F.lit(1)).cast("long").alias("rank"), F.lit(0.0).alias("part")))
        else:
            at = (n - 1) * F.lit(q)
            wanted += [F.struct(F.lit(name).alias("name"), (f(at) + 1).cast("long").alias("rank"), (F.lit(0.0) if f is F.floor else at - F.floor(at)).alias("part")) for f in (F.floor, F.ceil)]
    counts = scratch.save(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "counts")
    none = F.lit(None).cast(kind)
    targets = counts.select(*by, "n", F.posexplode(F.array(*wanted)).alias("target", "w")).select(*by, "target", F.col("w.rank").alias("rank"), F.col("n").alias("size"), none.alias("low"), none.alias("high"))
    targets = scratch.save(targets, "targets-0")
    turn = 0
    wide = (F.col("size") > few) & F.coalesce(F.col("low") < F.col("high"), F.lit(True))
    while targets.where(wide).limit(1).count():
        turn += 1
        open_ = targets.where(wide)
        inside = _met(rows, open_, by)
        grid = [i / POINTS for i in range(POINTS + 1)]
        sketch = inside.groupBy(*by, "target").agg(F.first("rank").alias("rank"), F.first("size").alias("size"), F.first("low").alias("low"), F.first("high").alias("high"), F.percentile_approx("v", grid, 10 * POINTS).alias("grid"))
        place = F.floor((F.col("rank") - 1) * POINTS / F.col("size")).cast("int")
        split = scratch.save(sketch.select(*by, "target", "rank", "size", "low", "high", F.get("grid", F.greatest(place - 1, F.lit(0))).alias("a"), F.get("grid", F.least(place + 2, F.lit(POINTS))).alias("b")), f"split-{turn}")
        # Below a, at a, between, at b, above b: where b is a, the last three are above.
        regions = {"below": "v < a", "at_a": "v = a", "inner": "v > a and v < b", "at_b": "v = b and b > a", "above": "v > b"}
        between = _met(rows, split, by).groupBy(*by, "target").agg(*[F.first(c).alias(c) for c in ("rank", "low", "high", "a", "b")], *[F.expr(f"count_if({x})").alias(k) for k, x in regions.items()], *[F.expr(f"{f}(case when {regions[k]} then v end)").alias(f"{f}_{k}") for k, f in (("below", "max"), ("inner", "min"), ("inner", "max"), ("above", "min"))])
        bounds = {"below": ("low", "max_below"), "at_a": ("a", "a"), "inner": ("min_inner", "max_inner"), "at_b": ("b", "b"), "above": ("min_above", "high")}
        before, new = F.lit(0), None
        for k, (low, high) in bounds.items():
            case = F.struct((F.col("rank") - before).alias("rank"), F.col(k).alias("size"), F.col(low).alias("low"), F.col(high).alias("high"))
            inside_k = F.col("rank") <= before + F.col(k)
            new = F.when(inside_k, case) if new is None else new.when(inside_k, case)
            before = before + F.col(k)
        narrowed = between.select(*by, "target", new.alias("new")).select(*by, "target", "new.*")
        rest = targets.join(open_.select(*by, "target"), [*by, "target"], "left_anti") if by else targets.join(open_.select("target"), "target", "left_anti")
        targets = scratch.save(rest.unionByName(narrowed), f"targets-{turn}")
    each = _met(rows, targets, by).groupBy(*by, "target", "v").agg(F.count(F.lit(1)).alias("times"), F.first("rank").alias("rank"))
    up_to = Window.partitionBy(*by, "target").orderBy("v")
    found = each.withColumn("last", F.sum("times").over(up_to)).where((F.col("last") >= F.col("rank")) & (F.col("last") - F.col("times") < F.col("rank")))
    found = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("target", "v"))).alias("got"))
    out = counts.join(found, by, "left") if by else counts.crossJoin(found)  # without groups, one row each
    columns, k = [], 0
    for name, (how, q) in points.items():
        if how == "nearest":
            columns.append(F.try_element_at("got", F.lit(k)).alias(name))
            k += 1
        else:
            a, b = (F.try_element_at("got", F.lit(k + i)).cast("double") for i in (0, 1))
            at = (F.col("n") - 1) * F.lit(q)
            columns.append((a + (b - a) * (at - F.floor(at))).alias(name))
            k += 2
    return out.select(*by, "n", *columns)


def _met(rows: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the targets whose interval they are in; a target without bounds takes all rows of its group."""
    marks = targets.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in targets.columns if c not in by])
    on = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_by_{c}")), by, F.lit(True))
    # Groups are met by key.  Without groups there are as few targets as points, which the caller names.
    met = rows.join(marks, on) if by else rows.crossJoin(F.broadcast(marks))
    return met.where((F.col("low").isNull() | (F.col("v") >= F.col("low"))) & (F.col("high").isNull() | (F.col("v") <= F.col("high")))).drop(*[f"_by_{c}" for c in by])
