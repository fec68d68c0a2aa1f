"""What the columns of a source look like, and which of them may identify a row."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.lexeme import DECIMAL, INTEGER

# Words in column names that speak of identity and of repeated runs.
IDENTITY_WORDS = ["id", "dataset", "model", "split", "seed", "run", "fold", "method", "experiment", "task", "config", "key", "name", "trial", "repeat", "replicate", "variant", "condition", "subject", "group"]
REPEAT_WORDS = ["seed", "run", "fold", "trial", "repeat", "replicate"]


def words(name: Column) -> Column:
    """F-28: the words of a column name."""
    return F.array_distinct(F.split(F.lower(name), r"[\s_\-./]+"))


def column_profile(source: DataFrame, order: str | None = None) -> DataFrame:
    """A-13, A-25, F-29: (column, type, reason, n, distinct, missing, kinds, examples) from one pass over all columns.

    Values are counted once for each (column, value), which the distinct
    number, the examples and all flags come from; a column with one value in a
    third of its rows is pre-aggregated.  Types are taken in a fixed order:
    empty, leading zero, identity name, missing, integer, decimal, text.
    """
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    rows = source.withColumn("_at", F.col(order) if order else F.monotonically_increasing_id()).select(
        "_at", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"), F.lit(kinds[c]).alias("kind")) for c in source.columns])).alias("x")
    )
    each = rows.select("_at", "x.*").groupBy("column", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    v = F.col("value")
    present = v.isNotNull() & (v != "")
    flags = each.groupBy("column", "kind").agg(
        F.sum("n").alias("n"),
        F.count("value").alias("distinct"),
        F.coalesce(F.sum(F.when(~F.coalesce(present, F.lit(False)), F.col("n"))), F.lit(0)).alias("missing"),
        F.expr("bool_or(value rlike '^[+-]?0[0-9]')").alias("zeros"),
        F.expr(f"bool_and(value rlike '{INTEGER.replace(chr(92), chr(92) * 2)}') filter (where value <> '')").alias("whole"),
        F.expr(f"bool_and(value rlike '{DECIMAL.replace(chr(92), chr(92) * 2)}') filter (where value <> '')").alias("real"),
        F.transform(F.slice(F.array_sort(F.min(F.when(present, F.array(F.struct("first", "value"))))), F.lit(1), F.lit(1)), lambda x: x["value"]).alias("first_value"),
    )
    # The first three distinct values, by the three least places; no list of all values is built.
    from pyspark.sql import Window

    firsts = each.where("value is not null").withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("first", "value"))).where("r <= 3")
    examples = firsts.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("examples"))
    w = words(F.col("column"))
    identity = F.arrays_overlap(w, F.array(*[F.lit(x) for x in IDENTITY_WORDS if x not in REPEAT_WORDS]))
    reason = (
        F.when(F.col("missing") == F.col("n"), "empty")
        .when(F.col("zeros"), "leading_zero")
        .when(identity, "identity_name")
        .when(F.col("missing") > 0, "missing")
        .when(F.col("whole"), "integer")
        .when(F.col("real"), "decimal")
        .otherwise("text")
    )
    kind = F.when(reason.isin("integer", "decimal"), reason).otherwise("string")
    out = flags.join(examples, "column", "left")
    return out.select("column", kind.alias("type"), reason.alias("reason"), "n", "distinct", "missing", F.array(F.col("kind")).alias("kinds"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def key_candidates(source: DataFrame, candidates: list[str], most: int = 256, size: int = 3) -> DataFrame:
    """A-14, T-10: (ord, columns, distinct, rows, is_key) of column sets, all candidates first, then one to ``size`` at a time.

    One pass: exact distinct counts of all combinations over a single scan.
    """
    sets = list(dict.fromkeys([tuple(candidates), *(c for k in range(1, min(size, len(candidates)) + 1) for c in combinations(candidates, k))]))[:most]
    grouped = None
    for i, s in enumerate(sets):
        one = source.groupBy(F.xxhash64(*s).alias("h"), *[F.col(c) for c in s]).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("rows"))
        one = one.select(F.lit(i).alias("ord"), F.array(*map(F.lit, s)).alias("columns"), "distinct", F.coalesce("rows", F.lit(0)).alias("rows"))
        grouped = one if grouped is None else grouped.unionByName(one)
    return grouped.withColumn("is_key", F.col("distinct") == F.col("rows"))


def roles(profile: DataFrame) -> DataFrame:
    """A-15, C-09: (column, role): group_by, repeat, constant, result or other."""
    w = words(F.col("column"))
    candidate = F.arrays_overlap(w, F.array(*map(F.lit, IDENTITY_WORDS))) & (F.col("missing") == 0)
    repeat = F.arrays_overlap(w, F.array(*map(F.lit, REPEAT_WORDS)))
    role = F.when(candidate & repeat, "repeat").when(candidate & (F.col("distinct") > 1), "group_by").when(candidate, "constant").when(F.col("type").isin("integer", "decimal"), "result").otherwise("other")
    return profile.select("column", role.alias("role"))


def dependencies(source: DataFrame, columns: list[str], size: int = 2, error: float = 0.02) -> DataFrame:
    """A-14, A-15: (determinant, dependent) of all minimal functional dependencies of up to ``size`` columns; nulls are values like any other.

    The lattice of column sets is walked level by level.  A set determines a
    column if both together have no more distinct rows than the set alone.  One
    pass of sketches over all sets of a level, and those with one column more,
    rules most candidates out: where the estimates differ by far more than
    their error.  Only what is left is counted exactly, each set once.
    """
    held: list[tuple[tuple[str, ...], str]] = []
    for k in range(1, size + 1):
        known = lambda s, c: any(c == b and set(a) <= set(s) for a, b in held)
        # A set that holds a dependency inside adds nothing to what a smaller one determines.
        sets = [s for s in combinations(columns, k) if not any(known(tuple(x for x in s if x != c), c) for c in s)]
        tried = [(s, c) for s in sets for c in columns if c not in s and not known(s, c)]
        if not tried:
            continue
        wanted = list(dict.fromkeys([*(s for s, _ in tried), *(tuple(sorted((*s, c), key=columns.index)) for s, c in tried)]))
        guess = dict(zip(wanted, source.agg(*[F.approx_count_distinct(F.struct(*w), error).alias(f"n{i}") for i, w in enumerate(wanted)]).first(), strict=True))
        both = lambda s, c: tuple(sorted((*s, c), key=columns.index))
        # Estimates off by six deviations on either side are taken as possible.
        left = [(s, c) for s, c in tried if guess[both(s, c)] * (1 - 6 * error) <= guess[s] * (1 + 6 * error)]
        needed = list(dict.fromkeys([*(s for s, _ in left), *(both(s, c) for s, c in left)]))
        if not needed:
            continue
        exact = None
        for i, w in enumerate(needed):
            one = source.groupBy(*w).agg(F.lit(1).alias("_one")).agg(F.count("_one").alias("n")).select(F.lit(i).alias("i"), "n")
            exact = one if exact is None else exact.unionByName(one)
        count = {needed[r.i]: r.n for r in exact.collect()}
        held += [(s, c) for s, c in left if count[s] == count[both(s, c)]]
    return source.sparkSession.createDataFrame([(list(s), c) for s, c in held], "determinant array<string>, dependent string")
