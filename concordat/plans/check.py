"""The checks that users call: evidence, documents and declarations in, states and findings out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.operators import intervals, states, textscan
from concordat.operators.metrics import Derived, Metric, derive, evaluate
from concordat.operators.scratch import Scratch
from concordat.plans.scope import active_exclusions, context_hash, scope_regions


__all__ = ["Report", "active_exclusions", "check", "context_hash", "coverage", "located_texts"]


@dataclass
class Report:
    """C-01: the tables of one check; the metrics are computed, the rest is lazy and reads them."""

    metrics: DataFrame
    bindings: DataFrame
    claims: DataFrame
    findings: DataFrame
    coverage: DataFrame
    exit_code: DataFrame
    unbound: DataFrame | None = None


def check(evidence: DataFrame, types: dict[str, str], metrics: list[Metric], derived: list[Derived], bindings: DataFrame, located: DataFrame, claims: DataFrame, health: DataFrame | None = None) -> Report:
    """C-01: metrics, derived metrics, binding and claim states, findings, coverage and exit code."""
    # Derived metrics are saved level by level, so the evidence is read once, whatever is asked of the report.
    all_ = derive(evaluate(evidence, metrics, types, health, fingerprints=False).select("metric", "value", "unit", "error"), derived)
    b = states.binding_states(bindings, all_, located)
    c = states.claim_states(claims, all_)
    found = states.findings(b, c)
    every = b.select("status").unionByName(c.select("status"))
    return Report(all_, b, c, found, states.coverage(every), states.exit_code(found))


def located_texts(documents: DataFrame, anchors: DataFrame) -> DataFrame:
    """(binding, actual, error) of anchors (binding, doc_id, exact or prefix and suffix), each found once or an error."""
    a = anchors.withColumnRenamed("binding", "anchor_id")
    hits = textscan.literal_hits(documents, a.where("exact is not null").select("anchor_id", "doc_id", "exact")).unionByName(textscan.between_hits(documents, a.where("exact is null").select("anchor_id", "doc_id", "prefix", "suffix")))
    one = textscan.unique_or_unknown(a, hits).join(a.select("anchor_id", "doc_id").hint("merge"), "anchor_id").join(documents.select("doc_id", "text", F.lit(True).alias("there")).hint("merge"), "doc_id", "left")
    error = F.when(F.col("there").isNull(), "UNREACHABLE_DOCUMENT").otherwise(F.col("error"))
    return one.select(F.col("anchor_id").alias("binding"), F.when(error.isNull(), F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))).alias("actual"), error.alias("error"))


def located_rows(rows: DataFrame) -> DataFrame:
    """``located_texts`` where each row has its own text, prefix and suffix: adds actual, place_error, start and end, without a join."""
    out = textscan.sole_places(rows).withColumnRenamed("error", "place_error")
    return out.withColumn("actual", F.when(F.col("place_error").isNull(), F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))))


def coverage(documents: DataFrame, bound: DataFrame, exclusions: DataFrame, scope: DataFrame | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """C-04, J-06, J-20, P-13, F-31: (doc_id, start, end, token, state) of all checkable numbers: bound, excluded, outside_scope or unbound.

    ``exclusions`` (ord, doc_id, start, end, context_hash) count only if the 80
    characters on both sides are unchanged and they overlap neither a bound
    span nor an earlier active exclusion.  ``scope`` (doc_id) names the
    documents under review, ``kinds`` the regions (abstract, table) in them.
    """
    scratch = Scratch(documents.sparkSession, "coverage")
    key = ["doc_id", "start", "end"]
    # These are read several times, and cutting numbers out of texts costs far more than reading them again.
    tokens = scratch.save(textscan.number_tokens(documents, context=0).select(*key, "token"), "tokens")
    spans = scratch.save(textscan.checkable(documents, tokens), "spans")
    bound = scratch.save(bound.select(*key), "bound")
    good = active_exclusions(documents, bound, exclusions).where("error is null")
    marks = _marks(bound, "bound").unionByName(_marks(good, "excluded"))
    if kinds:
        marks = marks.unionByName(_marks(scope_regions(documents, scope, kinds), "region"))
    inside = F.expr("mark = 'region' and r_start <= start and end <= r_end")
    hit = intervals.overlap_join(spans.select(*key), marks).groupBy(*key).agg(
        F.bool_or(F.col("mark") == "bound").alias("is_bound"), F.bool_or(F.col("mark") == "excluded").alias("is_excluded"), F.bool_or(inside).alias("in_region")
    )
    out = spans.join(hit.hint("merge"), key, "left").withColumn("in_scope", F.coalesce("in_region", F.lit(False)) if kinds else F.lit(True))
    if scope is not None and not kinds:
        out = out.drop("in_scope").join(scope.select("doc_id").distinct().withColumn("in_scope", F.lit(True)).hint("merge"), "doc_id", "left")
    state = F.when(F.col("is_bound"), "bound").when(F.col("is_excluded"), "excluded").when(~F.coalesce("in_scope", F.lit(False)), "outside_scope").otherwise("unbound")
    return out.select("doc_id", "start", "end", "token", state.alias("state"))


def _marks(spans: DataFrame, mark: str) -> DataFrame:
    return spans.select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.lit(mark).alias("mark"))
