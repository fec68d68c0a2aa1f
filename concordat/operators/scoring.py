"""Scores of submitted bindings and positions against gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordat.functions.lexeme import fingerprint


def contract_mark(rows: DataFrame) -> DataFrame:
    """E-06: adds ``contract``, a fingerprint in which the order of keys and seeds doesn't matter."""
    return rows.withColumn("contract", fingerprint("source", "field", "reduce", "unit", F.to_json(F.array_sort(F.map_entries("where"))), F.array_join(F.array_sort(F.coalesce("seeds", F.array().cast("array<string>"))), ",")))


def mapping_outcomes(submitted: DataFrame, gold: DataFrame) -> DataFrame:
    """J-25, W-14, E-01: (candidate, case, outcome) of submissions (candidate, case, ord, location, contract, valid).

    ``gold`` has case, location, contract and answerable.  Outcomes in order:
    invalid, duplicate_target, proposal_despite_insufficient_evidence,
    wrong_position, contract_mismatch, match.
    """
    again = F.row_number().over(Window.partitionBy("case", "location").orderBy("ord")) > 1
    s = submitted.withColumn("again", again)
    at = gold.select("case", "location", F.col("contract").alias("gold_contract"))
    open_ = gold.groupBy("case").agg(F.max(F.col("answerable").cast("int")).alias("answerable"))
    met = s.join(open_, "case", "left").join(at, ["case", "location"], "left")
    outcome = (
        F.when(~F.col("valid"), "invalid")
        .when(F.col("again"), "duplicate_target")
        .when(F.coalesce("answerable", F.lit(0)) == 0, "proposal_despite_insufficient_evidence")
        .when(F.col("gold_contract").isNull(), "wrong_position")
        .when(F.col("gold_contract") != F.col("contract"), "contract_mismatch")
        .otherwise("match")
    )
    return met.select("candidate", "case", outcome.alias("outcome"))


def mapping_score(outcomes: DataFrame, gold: DataFrame, unreviewed: int = 0) -> DataFrame:
    """E-01, E-02: one row (submitted, matched, wanted, missing, abstained, precision); precision only when all is reviewed."""
    n = outcomes.agg(F.count(F.lit(1)).alias("submitted"), F.count_if(F.col("outcome") == "match").alias("matched"))
    wanted = gold.agg(F.count_if("answerable").alias("wanted"))
    quiet = gold.where("not answerable").select("case").distinct().join(outcomes.select("case").distinct(), "case", "left_anti").agg(F.count(F.lit(1)).alias("abstained"))
    out = n.crossJoin(wanted).crossJoin(quiet)  # three single rows
    precision = F.when(F.lit(unreviewed == 0) & (F.col("submitted") > 0), F.col("matched") / F.col("submitted"))
    return out.select("submitted", "matched", "wanted", (F.col("wanted") - F.col("matched")).alias("missing"), "abstained", precision.alias("precision"))


def confusion(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """A-26: counts of outcomes overall and by each of the given columns, with ``level`` naming the grouping."""
    outcomes.createOrReplaceTempView("_concordat_outcomes")
    sets = ", ".join(["(outcome)"] + [f"({c}, outcome)" for c in by])
    return outcomes.sparkSession.sql(f"select {', '.join(by)}, outcome, count(*) as n, grouping_id() as level from _concordat_outcomes group by grouping sets ({sets})")


def usage(actions: DataFrame, by: list[str]) -> DataFrame:
    """A-27: tokens, seconds and invalid actions."""
    return actions.groupBy(*by).agg(F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"), F.count_if(~F.col("valid")).alias("invalid_actions"), F.count(F.lit(1)).alias("actions"))


def count_guard(metrics: DataFrame, edges: DataFrame, declared: DataFrame) -> DataFrame:
    """P-18: (metric, guarded): whether every leaf metric declares the number of rows that was seen."""
    from concordat.operators.graphs import leaves

    own = metrics.select(F.col("metric").alias("leaf"), "n").join(declared.select(F.col("metric").alias("leaf"), "expected_count"), "leaf", "left")
    lone = metrics.select(F.col("metric").alias("root"), F.col("metric").alias("leaf"))
    spread = lone.join(edges, F.col("root") == F.col("src"), "left_anti").unionByName(leaves(edges).select("root", "leaf")).distinct()
    return spread.join(own, "leaf").groupBy(F.col("root").alias("metric")).agg(F.expr("bool_and(coalesce(expected_count = n, false))").alias("guarded"))


def positions(before: DataFrame, after: DataFrame, gold: DataFrame, found: DataFrame) -> DataFrame:
    """E-03: (target, outcome) of gold targets with a controlled change of their values.

    ``found`` (left_id, n, right_id) comes from positions_match, ``before`` and
    ``after`` (target, status) from two checks: supported needs one place, pass
    before and mismatch after.
    """
    met = gold.select("target").join(found.select(F.col("left_id").alias("target"), "n"), "target", "left").join(before.select("target", F.col("status").alias("b")), "target", "left").join(after.select("target", F.col("status").alias("a")), "target", "left")
    outcome = F.when(F.coalesce("n", F.lit(0)) == 0, F.when(F.col("b").isNull() | (F.col("b") == "unknown"), "unknown").otherwise("mislocated")).when(F.col("n") > 1, "mislocated").when((F.col("b") == "pass") & (F.col("a") == "mismatch"), "supported").otherwise("missed")
    return met.select("target", outcome.alias("outcome"))


def containers(gold: DataFrame, boxes: DataFrame) -> DataFrame:
    """E-04: (target, boxes, outcome) of gold tokens (as in ``boxes_holding``): supported in exactly one container with their text, else ambiguous or missed."""
    from concordat.operators.intervals import boxes_holding

    n = boxes_holding(gold, boxes).groupBy("token_id").agg(F.count(F.lit(1)).alias("boxes"))
    met = gold.select("token_id").join(n, "token_id", "left").withColumn("boxes", F.coalesce("boxes", F.lit(0)))
    return met.select(F.col("token_id").alias("target"), "boxes", F.when(F.col("boxes") == 1, "supported").when(F.col("boxes") > 1, "ambiguous").otherwise("missed").alias("outcome"))


# The fault scenarios, of evidence, of documents and of patches, and what must come of a binding that passes without them.
SCENARIOS = [
    ("unchanged", "pass", None), ("changed_test", "mismatch", None), ("low_bit_change", "mismatch", None), ("unrelated_model", "pass", None), ("changed_train", "pass", None),
    ("missing_seed", "unknown", "SEED_SET"), ("duplicate_key", "unknown", "SEED_SET"), ("nonfinite", "unknown", "INVALID_NUMBER"), ("empty_selection", "unknown", "UNKNOWN_METRIC"), ("missing_column", "unknown", "INVALID_NUMBER"),
    ("anchor_missing", "unknown", "ANCHOR_MISSING"), ("ambiguous_anchor", "unknown", "ANCHOR_AMBIGUOUS"), ("unsupported_macro", "unknown", "UNSUPPORTED_DISPLAY"), ("patch_roundtrip", "mismatch", None), ("stale_patch", "mismatch", None),
]
_CHANGED = ("changed_test", "patch_roundtrip", "stale_patch")
_OF_TEXT = ("anchor_missing", "ambiguous_anchor", "unsupported_macro")


def evidence_scenario(scenario: str) -> str:
    """The scenario with the same evidence that stands for it: a fault of text leaves the evidence as it is, and those of patches change it as changed_test does."""
    return "unchanged" if scenario in _OF_TEXT else "changed_test" if scenario in _CHANGED else scenario


def inject_faults(evidence: DataFrame, scenarios: list[str] | None = None) -> DataFrame:
    """E-05: the evidence (dataset, model, split, seed, value) once for each scenario, all or the named ones, with its fault if it is one of evidence."""
    names = scenarios or [s for s, _, _ in SCENARIOS]
    target = (F.col("model") == "target") & (F.col("split") == "test")
    # Fifteen scenarios at most, and one of them twice for the rows that it repeats.
    own, again = F.array(*map(F.lit, names)), F.array(*map(F.lit, [*names, *[s for s in names if s == "duplicate_key"]]))
    all_ = evidence.withColumn("scenario", F.explode(F.when(target & (F.col("seed") == "1"), again).otherwise(own)))
    s, v = F.col("scenario"), F.col("value")

    def more(x: str):
        return (v.cast("decimal(24,12)") + F.lit(x).cast("decimal(24,12)")).cast("string")

    value = (
        F.when(s.isin(*_CHANGED) & target, more("0.1"))
        .when((s == "low_bit_change") & target & (F.col("seed") == "1"), more("0.003"))
        .when((s == "unrelated_model") & (F.col("model") == "decoy"), "0.123")
        .when((s == "changed_train") & (F.col("split") == "train"), "0.321")
        .when((s == "nonfinite") & target & (F.col("seed") == "2"), "NaN")
        .when(s == "missing_column", F.lit(None).cast("string"))
        .otherwise(v)
    )
    gone = ((s == "missing_seed") & target & (F.col("seed") == "3")) | ((s == "empty_selection") & target)
    return all_.withColumn("value", value).where(~gone)


def inject_text_faults(documents: DataFrame, prefix: str, suffix: str, value: str) -> DataFrame:
    """E-05: documents (doc_id, scenario, text) with the fault of their scenario, if it is one of text, at ``prefix``, the column ``value``, ``suffix``.

    The context is rewritten, repeated in a comment, or the number wrapped in a
    macro that nobody knows.
    """
    full = F.concat(F.lit(prefix), F.col(value), F.lit(suffix))
    s = F.col("scenario")
    faulty = (
        F.when(s == "anchor_missing", F.concat(F.lit(prefix.replace(" ", " [rewritten] ", 1)), F.col(value), F.lit(suffix)))
        .when(s == "ambiguous_anchor", F.concat(full, F.lit("\n% as before: "), full, F.lit("\n")))
        .when(s == "unsupported_macro", F.concat(F.lit(prefix + "\\unknownmacro{"), F.col(value), F.lit("}" + suffix)))
    )
    return documents.withColumn("text", F.when(faulty.isNull(), F.col("text")).otherwise(F.replace("text", full, faulty)))
