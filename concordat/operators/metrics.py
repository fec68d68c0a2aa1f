"""Declared metrics over evidence: selection, reductions under completeness contracts, batch matrices and derived values.

Results are fail-closed: a metric has a value or an error code, never both and
never a silently reduced value.  Errors come in one fixed order of evaluation:
source health, columns and selectors, seeds, emptiness, count, ambiguity,
missing or invalid numbers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import exact, limbs
from concordat.functions import lexeme as lx
from concordat.operators import digests, scans
from concordat.operators.declared import declared


@dataclass
class Metric:
    """A source metric: what to select, how to reduce it, and what must hold."""

    name: str
    field: str
    reduce: str
    unit: str = "scalar"
    where: dict[str, str] = field(default_factory=dict)
    expected_count: int | None = None
    seed_column: str | None = None
    expected_seeds: list[str] | None = None
    ddof: int = 1
    level: str | None = None
    source: str = "evidence"


@dataclass
class Derived:
    """A derived metric: a closed operation on two other metrics."""

    name: str
    op: str
    left: str
    right: str


def contract_errors(metrics: list[Metric], types: dict[str, str]) -> dict[str, str]:
    """P-03, P-07, P-08, P-17: errors that the declaration alone shows, by metric name."""
    out = {}
    for m in metrics:
        columns = [m.field, *m.where, *([m.seed_column] if m.seed_column else [])]
        if m.reduce not in lx.REDUCTIONS or m.unit not in lx.UNITS or (m.reduce == "count") != (m.unit == "count"):
            out[m.name] = "CONTRACT"
        elif m.expected_seeds is not None and (not m.expected_seeds or len(set(m.expected_seeds)) != len(m.expected_seeds) or not m.seed_column):
            out[m.name] = "CONTRACT"
        elif m.reduce == "statistics" and (m.ddof not in (0, 1) or (m.level is not None and (m.ddof != 1 or not 0.5 <= float(m.level) <= 0.999))):
            out[m.name] = "CONTRACT"
        elif any(c not in types for c in columns):
            out[m.name] = "MISSING_COLUMN"
        elif m.reduce != "count" and types[m.field] == "string":
            out[m.name] = "COLUMN_TYPE"
        elif any(types[c] == "integer" and not re.match(lx.INTEGER, v) or types[c] == "decimal" and not re.match(lx.DECIMAL, v) for c, v in m.where.items()):
            out[m.name] = "SELECTOR_TYPE"
    return out


def reduced(n: Column, nulls: Column, bad: Column, how: Column, expected: Column, seeds_ok: Column) -> Column:
    """The first error of a selection, in the order of evaluation."""
    return (
        F.when(~F.coalesce(seeds_ok, F.lit(True)), "SEED_SET")
        .when(F.coalesce(n, F.lit(0)) == 0, "EMPTY_SELECTION")
        .when(expected.isNotNull() & (n != expected), "RECORD_COUNT")
        .when((how == "unique") & (n != 1), "AMBIGUOUS_SELECTION")
        .when((how == "statistics") & (nulls > 0), "STATISTICS_MISSING")
        .when((how != "count") & ((nulls > 0) | (bad > 0)), "INVALID_NUMBER")
    )


def evaluate(evidence: DataFrame, metrics: list[Metric], types: dict[str, str], health: DataFrame | None = None, fingerprints: bool = True) -> DataFrame:
    """J-01 with A-01..A-08, A-23, A-24: one row (ord, metric, source, value, unit, error, n, fingerprint, statistics) for each metric.

    ``evidence`` has the declared columns as text.  Metrics with the same set
    of selector columns share one scan and one aggregation with exact partial
    sums (``functions.limbs``).  The sums of a set are one job, and one row for
    each declared metric, from which the values are made at once: the
    result is a local table.  ``health`` (source, error) makes every metric of
    a failed source unknown.  Without ``fingerprints`` the marks of the
    selected rows are not computed.
    """
    spark = evidence.sparkSession
    wrong = contract_errors(metrics, types)
    good = [m for m in metrics if m.name not in wrong]
    shape = lambda m: (sorted(m.where), m.seed_column or "")
    found = None
    for (keys, seed), group in groupby(sorted(good, key=shape), key=shape):
        part = _selected(evidence, list(group), keys, seed or None, types, fingerprints)
        found = part if found is None else found.unionByName(part)
    conf = declared(
        spark,
        [(i, m.name, m.source, m.unit, m.reduce, m.expected_count, m.expected_seeds is not None, m.ddof, m.level, wrong.get(m.name)) for i, m in enumerate(metrics)],
        "ord int, metric string, source string, unit string, reduce string, expected_count long, has_seeds boolean, ddof int, level string, declared_error string",
    )
    if found is None:
        found = declared(spark, [], f"metric string, {_FOUND}")
    joined = conf.join(found, "metric", "left")
    if health is not None:
        joined = joined.join(health.select("source", F.col("error").alias("health_error")), "source", "left")
    else:
        joined = joined.withColumn("health_error", F.lit(None).cast("string"))
    seeds_ok = F.when(F.col("has_seeds"), F.coalesce("seeds_ok", F.lit(False)))
    error = F.coalesce("health_error", "declared_error", reduced(F.col("n"), F.col("nulls"), F.col("bad"), F.col("reduce"), F.col("expected_count"), seeds_ok))
    return declared(spark, [_result(r) for r in joined.withColumn("error", error).collect()], f"ord int, metric string, source string, value string, unit string, error string, n long, fingerprint string, statistics struct<{exact.STATISTICS}>")


_FOUND = "n long, nulls long, bad long, wide long, limit long, total decimal(38,12), limbs array<struct<power int, limb decimal(38,0)>>, high decimal(38,0), cross decimal(38,0), low decimal(38,0), squares array<struct<power int, limb decimal(38,0)>>, digest string, seeds_ok boolean"


def _result(r) -> tuple:
    """The row of ``evaluate`` for one declared metric, from its sums and its error."""
    error, value, statistics = r.error, None, None
    if error is None and r.reduce == "count":
        value = str(r.n)
    elif error is None:
        total = limbs.total(r)
        if r.reduce == "statistics":
            got, error = (None, "STATISTICS_LIMIT") if r.limit else exact.moments(r.n, total, limbs.square(r), r.ddof, r.level)
            statistics = (*((got or {}).get(k) for k in exact.MOMENTS), error)
            value = got and got["mean"]
        else:
            value = exact.text_of(total / r.n if r.reduce == "mean" else total)
    return r.ord, r.metric, r.source, value if error is None else None, r.unit, error, r.n or 0, r.digest if error is None else None, statistics


def _selected(evidence: DataFrame, group: list[Metric], keys: list[str], seed: str | None, types: dict[str, str], fingerprints: bool) -> DataFrame:
    """The columns ``_FOUND`` of the metrics of one selector shape."""
    spark = evidence.sparkSession
    fields = sorted({m.field for m in group})
    rows = [(m.name, m.field, m.reduce, m.expected_seeds, *[_typed_text(m.where[k], types[k]) for k in keys]) for m in group]
    names = ["metric", "field", "reduce", "expected_seeds", *[f"k{i}" for i in range(len(keys))]]
    conf = declared(spark, rows, "metric string, field string, reduce string, expected_seeds array<string>" + "".join(f", k{i} string" for i in range(len(keys))))
    typed = [F.when(F.lit(types[k] == "string"), F.col(k)).otherwise(_typed_column(F.col(k), types[k])).alias(f"k{i}") for i, k in enumerate(keys)]
    identity = [c for c in evidence.columns if c in types and c not in fields]
    marks = [lx.fingerprint(*identity).alias("row_key") if identity else F.lit("").alias("row_key")] if fingerprints else []
    cells = evidence.select(*typed, *marks, (F.col(seed) if seed else F.lit(None)).cast("string").alias("seed"), *_lexemes(fields))
    value = limbs.gated(cells.join(conf, ["field", *names[4:]]), F.col("field").isin([f for f in fields if types[f] != "string"]))
    more: dict[str, tuple[Column, str]] = {}
    seeded = bool(seed) and any(m.expected_seeds is not None for m in group)
    if seeded:
        most = max(len(m.expected_seeds or []) for m in group)
        more |= _seed_counts(F.col("expected_seeds"), most)
    statistics = F.col("reduce") == "statistics" if any(m.reduce == "statistics" for m in group) else None
    sums = limbs.sums(value, ["metric"], statistics, more, few=True)
    selector = conf.select("metric", lx.fingerprint(*[n for n in names[1:] if n != "expected_seeds"]).alias("selector"), F.size("expected_seeds").alias("seeds_expected"))
    out = sums.join(selector, "metric")
    digest = F.lit(None).cast("string")
    if fingerprints:
        # A-11, T-07: the selected (key, value) rows as a multiset; equal numbers written differently are equal.
        marks_of = limbs.with_canonical(value, "canon").select("metric", F.sha2(F.concat_ws("|", "row_key", F.coalesce("canon", F.lit("null"))), 256).alias("mark"))
        out = out.join(digests.merkle(marks_of, ["metric"], "mark", sums.select("metric", "n")).select("metric", F.col("digest").alias("rows_digest")), "metric")
        digest = lx.sha256(F.concat_ws("|", "selector", F.col("n").cast("string"), "rows_digest"))
    ok = _seeds_hold(F.col("seeds_expected"), most) if seeded else F.lit(None).cast("boolean")
    return out.withColumns({"digest": digest, "seeds_ok": ok}).select("metric", *limbs.SUMS, "digest", "seeds_ok")


def _lexemes(fields: list[str]) -> list[Column]:
    """The columns field and lexeme, a row for each field."""
    if len(fields) == 1:
        return [F.lit(fields[0]).alias("field"), F.col(fields[0]).cast("string").alias("lexeme")]
    return [F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])).alias("field", "lexeme")]


def _seed_counts(expected: Column, most: int) -> dict[str, tuple[Column, str]]:
    """What is counted of a selection's seeds: all, those expected, and a bit for each expected one that there is; ``most`` is the longest declared list."""
    place = F.array_position(expected, F.col("seed"))
    there = place > 0
    bits = {f"seed_bits_{i}": (F.when(there & (F.floor((place - 1) / 62) == i), F.call_function("shiftleft", F.lit(1).cast("long"), ((place - 1) % 62).cast("int"))), "bit_or") for i in range(-(-most // 62))}
    return {"seeds": (F.when(F.col("seed").isNotNull(), 1).otherwise(0), "sum"), "seeds_known": (F.when(there, 1).otherwise(0), "sum")} | bits


def _seeds_hold(expected: Column, most: int) -> Column:
    """A-07: each expected seed once, and no other."""
    different = sum((F.coalesce(F.bit_count(F.col(f"seed_bits_{i}")), F.lit(0)) for i in range(-(-most // 62))), F.lit(0))
    return (F.col("seeds") == expected) & (F.col("seeds_known") == expected) & (different == expected)


def _typed_text(value: str, kind: str) -> str:
    if kind == "integer":
        return str(int(value))
    if kind == "decimal":
        from decimal import Decimal

        d = Decimal(value)
        sign, digits, exp = d.as_tuple()
        bare = "".join(map(str, digits)).lstrip("0").rstrip("0")
        return "0" if not bare else f"{'-' if sign else ''}{bare}e{exp + len(''.join(map(str, digits))) - len(''.join(map(str, digits)).rstrip('0'))}"
    return value


def _typed_column(text: Column, kind: str) -> Column:
    return F.regexp_replace(text, r"^\+", "") if kind == "integer" else lx.canonical(text)


def batch_matrix(evidence: DataFrame, group_by: list[str], fields: list[str], how: str = "mean", expected_count: int | None = None, seed: str | None = None, expected_seeds: list[str] | None = None) -> DataFrame:
    """A-09, A-10: one metric for each experiment group and field, from one scan with exact partial sums.

    Returns the group columns, field, n, value and error; ``value`` is the
    exact lexeme of a number of any length.  A group with a null identity is an
    error row of its own (MISSING_IDENTITY).
    """
    sums = batch_sums(evidence, group_by, fields, how, expected_count, seed, expected_seeds)
    return sums.select(*group_by, "field", "n", F.when(F.col("error").isNull(), batch_value(how)).alias("value"), "error")


def batch_value(how: str = "mean") -> Column:
    """The value of a row of ``batch_sums``; null where it is in error."""
    return F.when(F.col("error").isNull(), F.col("n").cast("string")) if how == "count" else exact.reduced_column(F.col("total"), F.col("limbs"), F.col("n") if how == "mean" else F.lit(1))


def batch_sums(evidence: DataFrame, group_by: list[str], fields: list[str], how: str = "mean", expected_count: int | None = None, seed: str | None = None, expected_seeds: list[str] | None = None, narrow: bool = False) -> DataFrame:
    """``batch_matrix`` before the last division: the group columns, field, n, total, limbs and error; no Python, so rows stay dealt as they were.

    ``narrow`` declares that all numbers fit DECIMAL(24,12), which spares a
    second aggregation; one that doesn't fails the job.
    """
    long = evidence.select(*group_by, (F.col(seed) if seed else F.lit(None)).cast("string").alias("seed"), *_lexemes(fields))
    wanted = None if expected_seeds is None else F.array(*map(F.lit, expected_seeds)).cast("array<string>")
    grouped = limbs.sums(limbs.gated(long, F.lit(True)), [*group_by, "field"], more=None if wanted is None else _seed_counts(wanted, len(expected_seeds)), narrow=narrow)
    seeds_ok = F.lit(None).cast("boolean") if wanted is None else _seeds_hold(F.lit(len(expected_seeds)), len(expected_seeds))
    missing = F.lit(False)
    for c in group_by:
        missing |= F.col(c).isNull()
    error = F.when(missing, "MISSING_IDENTITY").otherwise(reduced(F.col("n"), F.col("nulls"), F.col("bad"), F.lit(how), F.lit(expected_count), seeds_ok))
    total = F.coalesce("total", F.lit(0).cast("decimal(38,12)"))
    return grouped.select(*group_by, "field", "n", F.when(error.isNull(), total).alias("total"), F.when(error.isNull(), F.col("limbs")).alias("limbs"), error.alias("error"))


def derive(metrics: DataFrame, derived: list[Derived]) -> DataFrame:
    """J-03 with F-05..F-09, A-12, U-05: adds derived metrics to (metric, value, unit, error), in the order of their dependencies.

    An error of either side is the error of the derived metric.
    ``dependencies`` are the two metrics it is made of, ``evidence`` the
    different fingerprints (without those, names) of all source metrics below
    it.  The rows of the metrics that the declarations name, two for each of
    these at most, are taken at once; the rest of ``metrics`` is passed on.
    """
    spark = metrics.sparkSession
    own = F.array(F.coalesce("fingerprint", "metric") if "fingerprint" in metrics.columns else F.col("metric"))
    given = metrics.select("metric", "value", "unit", "error", F.array().cast("array<string>").alias("dependencies"), own.alias("evidence"))
    names = {d.name for d in derived}
    asked = sorted({x for d in derived for x in (d.left, d.right)} - names)
    known = {r.metric: tuple(r) for r in given.join(declared(spark, [(x,) for x in asked], "metric string"), "metric", "left_semi").collect()}
    order = TopologicalSorter({d.name: {d.left, d.right} & names for d in derived})
    try:
        sequence = list(order.static_order())
    except CycleError as e:
        raise ValueError(f"derived metrics form a cycle: {sorted(set(e.args[1]))}") from None
    rows, by_name = [], {d.name: d for d in derived}
    for d in (by_name[n] for n in sequence):
        left, right = known.get(d.left), known.get(d.right)
        value = unit = None
        error = "UNKNOWN_METRIC" if left is None or right is None else left[3] or right[3]
        if error is None:
            value, unit, error = exact.derive(d.op, left[1], left[2], right[1], right[2])
        sources = dict.fromkeys([*(left[5] if left else []), *(right[5] if right else [])])
        known[d.name] = (d.name, value, unit, error, [d.left, d.right], list(sources))
        rows.append(known[d.name])
    return given.unionByName(declared(spark, rows, "metric string, value string, unit string, error string, dependencies array<string>, evidence array<string>"))


def duplicate_keys(evidence: DataFrame, key: list[str]) -> DataFrame:
    """A-08: keys that occur more than once, with their number of rows; a key with a null part is MISSING_VALUE."""
    n = evidence.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    missing = None
    for c in key:
        missing = F.col(c).isNull() if missing is None else missing | F.col(c).isNull()
    return n.where(missing | (F.col("n") > 1)).withColumn("error", F.when(missing, "MISSING_VALUE").otherwise("DUPLICATE_KEY"))


def group_statistics(evidence: DataFrame, by: list[str], field: str, level: str | None = None, ddof: int = 1) -> DataFrame:
    """A-05, F-14 for every group: (by, n, statistics, error) from exact native sums of values and squares.

    The last steps of a group (one row: a root and a quantile) run in Arrow
    batches; groups of equal size share the quantile.
    """
    long = limbs.gated(evidence.select(*by, F.col(field).cast("string").alias("lexeme")), F.lit(True))
    grouped = limbs.sums(long, by, F.lit(True))
    error = reduced(F.col("n"), F.col("nulls"), F.col("bad"), F.lit("statistics"), F.lit(None), F.lit(None).cast("boolean"))
    error = F.coalesce(error, F.when(F.col("limit") > 0, "STATISTICS_LIMIT"))
    got = exact.moments_column(F.when(error.isNull(), F.struct(*limbs.SUMS)), ddof, level)
    out = grouped.withColumn("error", error).withColumn("statistics", got)
    return out.select(*by, "n", F.struct(*[f"statistics.{c}" for c in exact.MOMENTS]).alias("statistics"), F.coalesce("error", "statistics.error").alias("error"))


def reconciled(records: DataFrame, locations: DataFrame, key: list[str]) -> DataFrame:
    """J-28: (key, records, locations, error): whether each record has exactly one location and the other way round."""
    a, b = (t.groupBy(*key).agg(F.count(F.lit(1)).alias(n)) for t, n in ((records, "records"), (locations, "locations")))
    met = a.join(b, key, "full").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("records", "locations")})
    error = F.when(F.col("locations") == 0, "LOCATION_MISSING").when(F.col("records") == 0, "RECORD_MISSING").when((F.col("records") > 1) | (F.col("locations") > 1), "RECORD_COUNT")
    return met.select(*key, "records", "locations", error.alias("error"))


def source_health(cells: DataFrame) -> DataFrame:
    """A-23: (source, error): the error of the first bad line of each source; ``cells`` has source, line and error."""
    return cells.where("error is not null").groupBy("source").agg(F.min_by("error", F.struct("line", "error")).alias("error"))


def latency(values: DataFrame, by: list[str], column: str) -> DataFrame:
    """A-22: number, median and nearest-rank 95th percentile for each group; a group may be as large as the table."""
    return scans.quantiles(values, by, column, {"median": ("linear", 0.5), "p95": ("nearest", 0.95)})
