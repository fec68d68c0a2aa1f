"""States of bindings and claims, what blocks them, and the rollups over them.

All states are pass, mismatch or unknown; unknown carries an error code.
Tables: metrics (metric, value, unit, error), bindings and claims as declared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import exact
from concordat.functions import lexeme as lx
from concordat.operators import graphs, scans

SEVERITY = {"unknown": 2, "error": 1, "warning": 0}
# The kinds of work in the order in which they are shown.
ACTIONS = ["wait_for_check", "resolve_evidence", "review_producers", "update_fragments", "repair_bindings", "review_exclusions", "review_claims", "update_numbers", "update_document", "reexport_pdf", "update_figures", "complete_coverage"]
BUCKETS = ["added_failures", "resolved_failures", "unverified", "removed_bindings", "unchanged_failures", "changed_contracts", "current_failures_without_baseline"]


def binding_states(bindings: DataFrame, metrics: DataFrame, located: DataFrame) -> DataFrame:
    """J-02, J-26: (binding, metric, status, error, actual, expected): reported text against the rendered metric.

    ``bindings`` has binding, metric, kind, places, rounding, percent_symbol
    and format; ``located`` has binding, actual and error.
    """
    met = bindings.join(metrics.select("metric", "value", "unit", F.col("error").alias("metric_error"), F.lit(True).alias("there")).hint("merge"), "metric", "left").join(located.select("binding", "actual", F.col("error").alias("place_error")).hint("merge"), "binding", "left")
    return judged(met)


def judged(met: DataFrame, *keep: str) -> DataFrame:
    """``binding_states`` of bindings that already have their metric (value, unit, metric_error, there) and their place (actual, place_error) beside them; ``keep`` names further columns to pass on."""
    usable = F.col("metric_error").isNull() & F.col("there")
    met = met.withColumn("shown", exact.render_column(F.when(usable, F.col("value")), F.col("unit"), F.col("kind"), F.col("places"), F.col("rounding"), F.col("percent_symbol")))
    actual = lx.normalise_percent(F.col("actual"), F.col("format"))
    first = F.when(F.col("actual").isNull() & F.col("place_error").isNull(), "ANCHOR_MISSING").otherwise(F.col("place_error"))
    error = F.coalesce(F.when(F.col("there").isNull(), "UNKNOWN_METRIC"), "metric_error", first, "shown.error", F.when(~F.coalesce(actual.rlike(lx.PLAIN_DISPLAY), F.lit(False)), lx._let(actual, lambda x: lx.parse_display(x)["error"])))
    # Each is worked out once, however often it is named below.
    met = met.withColumns({"_error": error, "_same": lx.display_matches(actual, F.col("shown.text"))})
    met = met.withColumn("_status", F.when(F.col("_error").isNotNull() | F.col("_same").isNull(), "unknown").when(F.col("_same"), "pass").otherwise("mismatch"))
    return met.select("binding", "metric", F.col("_status").alias("status"), F.when(F.col("_status") == "unknown", F.coalesce("_error", F.lit("UNSUPPORTED_DISPLAY"))).alias("error"), "actual", F.col("shown.text").alias("expected"), *keep)


def claim_states(claims: DataFrame, metrics: DataFrame) -> DataFrame:
    """J-04, P-09, P-10: (claim, status, error, refs) of predicates over metrics.

    ``claims`` has claim, op, left, right (a metric), threshold, threshold_unit,
    candidates (metrics), direction and allow_ties.  best_in_set holds if left
    beats every candidate in the direction; a tie fails unless allowed.
    """
    m = metrics.select("metric", "value", "unit", "error")
    left = m.select(F.col("metric").alias("left"), F.col("value").alias("a"), F.col("unit").alias("u"), F.col("error").alias("left_error"), F.lit(True).alias("left_there"))
    other = F.when(F.col("op") == "best_in_set", F.transform("candidates", lambda c: F.struct(c.alias("ref"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("unit")))).otherwise(F.array(F.struct(F.col("right").alias("ref"), F.col("threshold").alias("value"), F.col("threshold_unit").alias("unit"))))
    each = claims.join(left, "left", "left").withColumn("o", F.explode_outer(other))
    right = m.select(F.col("metric").alias("ref"), F.col("value").alias("r_value"), F.col("unit").alias("r_unit"), F.col("error").alias("right_error"))
    each = each.withColumn("ref", F.col("o.ref")).join(right, "ref", "left").withColumns({"b": F.coalesce("o.value", "r_value"), "v": F.coalesce("o.unit", "r_unit")})
    gap = exact.derive_column(F.lit("difference"), F.when(F.col("left_error").isNull() & F.col("right_error").isNull(), F.col("a")), F.col("u"), F.col("b"), F.col("v"))
    each = each.withColumn("gap", gap)
    sign = F.signum(F.col("gap.value").try_cast("double"))
    tie = sign == 0
    best = F.when(tie, F.coalesce("allow_ties", F.lit(False))).otherwise(F.when(F.col("direction") == "minimize", sign < 0).otherwise(sign > 0))
    verdict = F.when(F.col("op") == "best_in_set", best).when(F.col("op") == "greater_than", sign > 0).when(F.col("op") == "greater_equal", sign >= 0).when(F.col("op") == "less_than", sign < 0).when(F.col("op") == "less_equal", sign <= 0).when(F.col("op") == "equal", tie)
    error = F.coalesce(F.when(F.col("left_there").isNull() | F.col("b").isNull() & F.col("right_error").isNull(), "UNKNOWN_METRIC"), "left_error", "right_error", "gap.error", F.when(verdict.isNull(), "UNKNOWN_OPERATION"))
    judged = each.withColumns({"verdict": verdict, "error": error})
    out = judged.groupBy("claim").agg(F.min("error").alias("error"), F.expr("bool_and(verdict)").alias("holds"), F.array_sort(F.array_union(F.collect_set("left"), F.collect_set("ref"))).alias("refs"))
    status = F.when(F.col("error").isNotNull(), "unknown").when(F.col("holds"), "pass").otherwise("mismatch")
    return out.select("claim", status.alias("status"), "error", "refs")


def scope_errors(claims: DataFrame, edges: DataFrame, selectors: DataFrame) -> DataFrame:
    """P-11: claims (claim, metric, scope map) with a leaf metric whose selector (metric, where map) lacks part of the scope."""
    near = graphs.leaves(edges) if not edges.isEmpty() else None
    roots = claims.select("metric").distinct()
    leaf = roots.select(F.col("metric").alias("root"), F.col("metric").alias("leaf")) if near is None else near.union(roots.join(near, F.col("metric") == F.col("root"), "left_anti").select(F.col("metric").alias("root"), F.col("metric").alias("leaf")))
    met = claims.join(leaf, F.col("metric") == F.col("root")).join(selectors.select(F.col("metric").alias("leaf"), "where"), "leaf", "left")
    inside = F.forall(F.map_entries("scope"), lambda e: F.coalesce(F.try_element_at("where", e["key"]) == e["value"], F.lit(False)))
    return met.where(~inside).select("claim", F.lit("SCOPE_MISMATCH").alias("error")).distinct()


def blocked_by(bindings: DataFrame, claims: DataFrame, edges: DataFrame) -> DataFrame:
    """J-16: (binding, blocked_by): mismatched bindings with the claims that don't pass and share a leaf metric."""
    leaf = graphs.leaves(edges)

    def spread(df: DataFrame, column: str) -> DataFrame:
        return df.join(leaf, F.col(column) == F.col("root"), "left").withColumn("leaf", F.coalesce("leaf", column)).drop("root")

    failing = spread(claims.where("status <> 'pass'").select("claim", F.explode("refs").alias("ref")), "ref").select("claim", "leaf")
    open_ = spread(bindings.where("status = 'mismatch'").select("binding", "metric"), "metric").select("binding", "leaf")
    return open_.join(failing, "leaf").groupBy("binding").agg(F.array_sort(F.collect_set(F.concat(F.lit("claim:"), "claim"))).alias("blocked_by"))


def findings(bindings: DataFrame, claims: DataFrame) -> DataFrame:
    """U-09: (id, rule, subject, severity) of all states that don't pass."""
    b = bindings.where("status <> 'pass'").select(F.when(F.col("status") == "mismatch", "VALUE_MISMATCH").otherwise(F.col("error")).alias("rule"), F.concat(F.lit("occurrence:"), "binding").alias("subject"), F.when(F.col("status") == "mismatch", "error").otherwise("unknown").alias("severity"))
    c = claims.where("status <> 'pass'").select(F.when(F.col("status") == "mismatch", "CLAIM_FALSE").otherwise(F.col("error")).alias("rule"), F.concat(F.lit("claim:"), "claim").alias("subject"), F.when(F.col("status") == "mismatch", "error").otherwise("unknown").alias("severity"))
    return b.unionByName(c).select(F.concat_ws("/", "subject", "rule").alias("id"), "rule", "subject", "severity")


def coverage(states: DataFrame) -> DataFrame:
    """A-16: one row (confirmed, pass, mismatch, unknown)."""
    s = F.col("status")
    return states.agg(F.count(F.lit(1)).alias("confirmed"), *[F.count_if(s == k).alias(k) for k in ("pass", "mismatch", "unknown")])


def exit_code(found: DataFrame) -> DataFrame:
    """A-17: 2 if any finding is unknown, else 1 if any is an error, else 0."""
    level = F.when(F.col("severity") == "unknown", 2).when(F.col("severity") == "error", 1).otherwise(0)
    return found.agg(F.coalesce(F.max(level), F.lit(0)).alias("exit_code"))


def actions(found: DataFrame, details: DataFrame | None = None, coverage: DataFrame | None = None) -> DataFrame:
    """A-18: (ord, kind, subject, id): findings as work of twelve kinds, one row for each.

    ``details`` (subject, blocked, format) tells what blocks a mismatch and
    where it stands.  ``coverage`` is one row (unbound, unregistered): where
    numbers are unbound or figures unregistered, the project itself needs
    complete_coverage, without a finding.
    """
    stale = found.where("rule = 'EXPORT_STALE'").select("subject", F.lit(True).alias("stale")).distinct()
    met = found.join(stale, "subject", "left")
    met = met.join(details, "subject", "left") if details is not None else met.withColumns({"blocked": F.lit(False), "format": F.lit("latex")})
    r, group = F.col("rule"), F.substring_index("subject", ":", 1)
    kind = (
        F.when(r == "WATCH_PENDING", "wait_for_check")
        .when((r == "EXPORT_STALE") | ((r == "VALUE_MISMATCH") & F.coalesce("stale", F.lit(False))), "reexport_pdf")
        .when((r == "VALUE_MISMATCH") & F.coalesce("blocked", F.lit(False)), "review_claims")
        .when((r == "VALUE_MISMATCH") & F.col("format").isin("docx", "pdf"), "update_document")
        .when(r == "VALUE_MISMATCH", "update_numbers")
        .when((group == "claim") & (r == "CLAIM_FALSE"), "review_claims")
        .when(group == "figure", "update_figures")
        .when(group == "provenance", "review_producers")
        .when(group == "fragment", "update_fragments")
        .when(r.startswith("ANCHOR_") | r.isin("UNREACHABLE_TEX", "UNREACHABLE_DOCUMENT", "NUMERIC_SPAN", "NUMERIC_ANCHOR", "UNSUPPORTED_SPAN", "PDF_EXTRACTION_CHANGED"), "repair_bindings")
        .when(r.startswith("EXCLUSION_"), "review_exclusions")
        .when(r.isin("NO_BINDINGS", "INCOMPLETE_COVERAGE"), "complete_coverage")
        .otherwise("resolve_evidence")
    )
    order = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("kind"))
    out = met.select(kind.alias("kind"), "subject", "id").distinct()
    if coverage is not None:
        lacking = coverage.where("unbound > 0 or unregistered > 0").select(F.lit("complete_coverage").alias("kind"), F.lit("project").alias("subject"), F.lit(None).cast("string").alias("id"))
        out = out.unionByName(lacking)
    return out.select(order.cast("int").alias("ord"), "kind", "subject", "id")


def action_counts(work: DataFrame) -> DataFrame:
    """A-18: (ord, kind, subjects, findings): how many different subjects and findings each kind of work has."""
    return work.groupBy("ord", "kind").agg(F.count_distinct("subject").alias("subjects"), F.count_distinct("id").alias("findings"))


# -- comparisons over time ------------------------------------------------


def baseline_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """J-13, C-02: (metric, change, before, after): added, unavailable, definition_changed, changed or unchanged, tested in this order.

    Both sides have metric, value, error, definition and fingerprint.
    """
    old = previous.select("metric", F.col("value").alias("before"), F.col("error").alias("old_error"), F.col("definition").alias("old_definition"), F.col("fingerprint").alias("old_fingerprint"), F.lit(True).alias("there"))
    met = current.join(old, "metric", "left")
    change = (
        F.when(F.col("there").isNull(), "added")
        .when(F.col("error").isNotNull() | F.col("old_error").isNotNull(), "unavailable")
        .when(~F.col("definition").eqNullSafe(F.col("old_definition")), "definition_changed")
        .when(~F.col("fingerprint").eqNullSafe(F.col("old_fingerprint")), "changed")
        .otherwise("unchanged")
    )
    return met.select("metric", change.alias("change"), "before", F.col("value").alias("after"))


def removed(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """U-03: what the baseline had and the current state hasn't."""
    return previous.select(*keys).distinct().join(current.select(*keys), keys, "left_anti")


def transitions(current: DataFrame, previous: DataFrame | None, changed_contracts: DataFrame | None = None) -> DataFrame:
    """J-14: (subject, before, after, bucket) of every check between two states (subject, status).

    A check that is gone, unknown or whose contract changed is never resolved.
    A changed contract is listed beside the failure bucket.
    """
    now = current.select("subject", F.col("status").alias("after"))
    has = previous is not None
    old = previous.select("subject", F.col("status").alias("before")) if has else now.limit(0).select("subject", F.col("after").alias("before"))
    met = now.join(old, "subject", "full")
    changed = changed_contracts.select("subject", F.lit(True).alias("modified")).distinct() if changed_contracts is not None else now.limit(0).select("subject", F.lit(True).alias("modified"))
    met = met.join(changed, "subject", "left").withColumn("modified", F.coalesce("modified", F.lit(False)) & F.col("before").isNotNull())
    after, before = F.col("after"), F.col("before")
    failing = F.when(F.lit(not has), "current_failures_without_baseline").when(before == "mismatch", "unchanged_failures").otherwise("added_failures")
    main = F.when(after.isNull(), "removed_bindings").when(after == "unknown", "unverified").when(after == "mismatch", failing).when((before == "mismatch") & ~F.col("modified"), "resolved_failures")
    also = F.when(after.isNotNull() & (after != "unknown") & F.col("modified"), "changed_contracts")
    return met.select("subject", "before", "after", F.explode(F.array_compact(F.array(main, also))).alias("bucket"))


def bucket_counts(moved: DataFrame) -> DataFrame:
    """A-21: the number in each bucket, zeros included."""
    every = moved.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, BUCKETS))).alias("bucket"))
    return every.join(moved.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def declaration_diff(before: DataFrame, after: DataFrame, keys: list[str], mark: str = "fingerprint") -> DataFrame:
    """U-01, U-02, U-04, U-08: (keys, change, before, after): added, removed or changed by fingerprint; unchanged ones are left out."""
    a = before.select(*keys, F.col(mark).alias("before"), F.lit(True).alias("_b"))
    b = after.select(*keys, F.col(mark).alias("after"), F.lit(True).alias("_a"))
    met = a.join(b, keys, "full")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return met.withColumn("change", change).where("change is not null").select(*keys, "change", "before", "after")


def impact_members(edges: DataFrame, metrics: DataFrame, bindings: DataFrame, claims: DataFrame, paths: DataFrame, figures: DataFrame) -> DataFrame:
    """J-17, C-05: (root, kind, name): for each root metric (one without dependencies) all that hangs on it; roots without consumers are left out.

    ``edges`` (src, dst) go from a metric to what it depends on; ``paths``
    (metric, path) and ``figures`` (figure, path) tell shared files.
    """
    up = graphs.closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), metrics.select(F.col("metric").alias("root"))).select("root", F.col("node").alias("metric"))
    roots = metrics.join(edges, F.col("metric") == F.col("src"), "left_anti").select(F.col("metric").alias("root"))
    reach = up.join(roots, "root", "left_semi")

    def of(rows: DataFrame, kind: str, name: str) -> DataFrame:
        return rows.select("root", F.lit(kind).alias("kind"), F.col(name).alias("name")).distinct()

    used = of(reach.join(bindings.select("binding", "metric"), "metric"), "binding", "binding")
    used = used.unionByName(of(reach.join(claims.select("claim", F.explode("refs").alias("metric")), "metric"), "claim", "claim"))
    used = used.unionByName(of(roots.join(paths, F.col("root") == F.col("metric")).join(figures, "path"), "figure", "figure"))
    held = of(reach, "metric", "metric").join(used.select("root").distinct(), "root", "left_semi")
    return held.unionByName(used)


def reviews(claims: DataFrame, history: DataFrame) -> DataFrame:
    """J-15: (claim, review): reviewed, superseded or unreviewed, by the fingerprint of the reviewed state."""
    n = claims.join(history.select("claim", F.col("fingerprint").alias("seen")), "claim", "left").groupBy("claim").agg(F.max((F.col("seen") == F.col("fingerprint")).cast("int")).alias("same"), F.count("seen").alias("n"))
    return n.select("claim", F.when(F.col("same") == 1, "reviewed").when(F.col("n") > 0, "superseded").otherwise("unreviewed").alias("review"))


def safe_changes(bindings: DataFrame, blocked: DataFrame) -> DataFrame:
    """P-16, T-08: mismatches that may be written: not blocked, in a writable format, ordered by place."""
    return bindings.where("status = 'mismatch' and format not in ('docx', 'pdf')").join(blocked.where(F.size("blocked_by") > 0), "binding", "left_anti").orderBy("file", "start", "binding")


def revision_list(states: DataFrame) -> DataFrame:
    """C-17, T-04, T-05: all states as one queue: unknown first, passed last, then kind and subject; ``rank`` is the place."""
    urgency = F.when(F.col("status") == "unknown", 0).when(F.col("status") == "mismatch", 1).otherwise(2)
    return scans.numbered(states.withColumn("urgency", urgency), ["urgency", "kind", "subject"]).select("rank", "subject", "kind", "status").orderBy("rank")
