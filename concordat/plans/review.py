"""What people do with a check: explain, propose, repair, accept, patch and attest, each as joins over its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.functions.lexeme import fingerprint, sha256
from concordat.operators import graphs, intervals, states, suggest, textscan


def explain(findings: DataFrame, refs: DataFrame, metrics: DataFrame, evidence: DataFrame, most: int = 20) -> DataFrame:
    """J-30, T-03: (id, metric, value, error, evidence, total, truncated): findings with the metrics of their subject (subject, metric) and their first rows of evidence (metric, ord, row)."""
    shown = suggest.first_n(evidence, ["metric"], ["ord"], most).groupBy("metric", "total", "truncated").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "row"))), lambda x: x["row"]).alias("evidence"))
    return findings.join(refs, "subject").join(metrics.select("metric", "value", "error"), "metric").join(shown, "metric", "left").select("id", "metric", "value", "error", "evidence", "total", "truncated")


def required(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """J-31: (name): what the selected declarations (name) need, themselves included, over edges (src, dst) from use to what is used."""
    return graphs.closure(edges, selected.select(F.col("name").alias("root"))).select(F.col("node").alias("name")).distinct()


def accept(selected: DataFrame, additions: DataFrame, existing: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C-25, U-06, U-07: (declarations to append with an audit fingerprint, what refuses the acceptance).

    Only what the selection needs of the additions (name, kind, definition) is
    taken.  It is refused where a selected name isn't offered or where a taken
    one exists with another definition.
    """
    taken = additions.join(required(selected, edges), "name", "left_semi")
    clash = taken.join(existing.select("name", F.col("definition").alias("old")), "name").where("definition <> old").select("name", F.lit("NAME_CONFLICT").alias("error"))
    absent = suggest.unavailable(selected, additions, "name")
    new = taken.join(existing.select("name"), "name", "left_anti").withColumn("audit", fingerprint("kind", "name", "definition"))
    return new, clash.unionByName(absent)


def proposal_states(additions: DataFrame, checked: DataFrame) -> DataFrame:
    """C-08, C-10: (binding, status, refused): proposed bindings after the merged check; one that is unknown is refused."""
    return additions.select("binding").join(checked.select("binding", "status"), "binding", "left").select("binding", F.coalesce("status", F.lit("unknown")).alias("status"), (F.coalesce("status", F.lit("unknown")) == "unknown").alias("refused"))


def proposals(selections: DataFrame, catalogue: DataFrame, locations: DataFrame, occupied: DataFrame) -> DataFrame:
    """C-07, C-08: bindings to propose: selections (choice, location) with the metric of the choice and the anchor of the place.

    ``catalogue`` has choice, metric and error, ``locations`` location, doc_id,
    start, end; a place that overlaps an occupied span, or a choice that is in
    error, gives an error row.
    """
    met = selections.join(catalogue, "choice", "left").join(locations, "location", "left")
    taken = intervals.overlap_join(met.where("start is not null").select("doc_id", "start", "end"), occupied.select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))).select("doc_id", "start", "end").distinct().withColumn("taken", F.lit(True))
    out = met.join(taken, ["doc_id", "start", "end"], "left")
    error = F.coalesce(F.when(F.col("metric").isNull(), "NOT_AVAILABLE"), F.col("error"), F.when(F.col("start").isNull(), "ANCHOR_MISSING"), F.when(F.col("taken"), "BINDING_OVERLAP"))
    return out.select("choice", "location", "metric", "doc_id", "start", "end", error.alias("error"))


def cards(proposed: DataFrame, metrics: DataFrame, evidence: DataFrame, conflicts: DataFrame, most: int = 5) -> DataFrame:
    """C-11: one row for each proposed binding: its metric's value, its first rows of evidence with their number, and what conflicts (binding, with)."""
    shown = suggest.first_n(evidence, ["metric"], ["ord"], most).groupBy("metric", "total", "truncated").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "row"))), lambda x: x["row"]).alias("rows"))
    against = conflicts.groupBy("binding").agg(F.array_sort(F.collect_set("with")).alias("conflicts"))
    return proposed.join(metrics.select("metric", "value", "unit", "error"), "metric", "left").join(shown, "metric", "left").join(against, "binding", "left")


def repairs(anchors: DataFrame, documents: DataFrame, previous: DataFrame) -> DataFrame:
    """J-21, C-12: (binding, error, hits, was_start, was_end, new_start, new_end) of bindings whose anchor no longer has one place.

    The new place is that of the number in the block with the same masked
    identity at which the binding stood (previous: binding, doc_id, identity,
    offset, start, end); nothing but the place changes.
    """
    a = anchors.withColumnRenamed("binding", "anchor_id")
    hits = textscan.literal_hits(documents, a.where("exact is not null").select("anchor_id", "doc_id", "exact"))
    broken = textscan.unique_or_unknown(a, hits).where("error is not null").select(F.col("anchor_id").alias("binding"), "error", "hits")
    blocks = textscan.blocks(documents)
    one = blocks.groupBy("doc_id", "identity").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("block_start")).where("n = 1")
    tokens = textscan.number_tokens(documents, native=True)
    placed = previous.join(one, ["doc_id", "identity"]).withColumn("at", F.col("block_start") + F.col("offset"))
    found = placed.join(tokens.select("doc_id", F.col("start").alias("at"), F.col("end").alias("new_end")), ["doc_id", "at"]).select("binding", F.col("at").alias("new_start"), "new_end")
    was = previous.select("binding", F.col("start").alias("was_start"), F.col("end").alias("was_end"))
    return broken.join(was, "binding", "left").join(found, "binding", "left")


def maintenance(edges: DataFrame, edited: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """C-06, J-18: (name, before, after): every declaration that an edit of the named ones reaches, with its state on both sides.

    ``edges`` (src, dst) go from what is used to what uses it.
    """
    reach = graphs.closure(edges, edited.select(F.col("name").alias("root"))).select(F.col("node").alias("name")).distinct()
    a = before.select("name", F.col("status").alias("before"))
    b = after.select("name", F.col("status").alias("after"))
    return reach.join(a, "name", "left").join(b, "name", "left")


def patches(bindings: DataFrame, blocked: DataFrame, documents: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """X-15, P-16: (doc_id, start, end, before, after, precondition, error) of the changes that may be written.

    ``precondition`` is the document's hash; a binding whose recorded hash
    (``document_hash``) differs is stale.
    """
    safe = states.safe_changes(bindings, blocked)
    if selected is not None:
        safe = safe.join(selected.select("binding"), "binding", "left_semi")
    met = safe.join(documents.select("doc_id", sha256("text").alias("precondition")), "doc_id", "left")
    return met.select("binding", "doc_id", "start", "end", F.col("actual").alias("before"), F.col("expected").alias("after"), "precondition", F.when(~F.col("precondition").eqNullSafe(F.col("document_hash")), "PATCH_STALE").alias("error"))


def recoverable(journal: DataFrame, documents: DataFrame) -> DataFrame:
    """X-17, C-28: (transaction, doc_id, state): each journal entry (transaction, doc_id, before_hash, after_hash) against the current text: applied, rolled_back or foreign."""
    now = documents.select("doc_id", sha256("text").alias("now"))
    met = journal.join(now, "doc_id", "left")
    return met.select("transaction", "doc_id", F.when(F.col("now") == F.col("after_hash"), "applied").when(F.col("now") == F.col("before_hash"), "rolled_back").otherwise("foreign").alias("state"))


def tasks(revisions: DataFrame, patchable: DataFrame, positions: DataFrame, blocked: DataFrame) -> DataFrame:
    """C-28: the revision list with flags: can be patched, can be annotated, is blocked."""
    out = revisions
    for table, flag in ((patchable, "patchable"), (positions, "annotatable"), (blocked, "is_blocked")):
        out = out.join(table.select("subject").distinct().withColumn(flag, F.lit(True)), "subject", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return out


def annotations(bindings: DataFrame, blocked: DataFrame, evidence_paths: DataFrame) -> DataFrame:
    """C-19: (binding, note): what a margin note at each binding would say."""
    met = bindings.join(blocked, "binding", "left").join(evidence_paths.groupBy("metric").agg(F.array_sort(F.collect_set("path")).alias("paths")), "metric", "left")
    lines = F.array_compact(F.array(F.concat(F.lit("status: "), "status"), F.concat(F.lit("reported: "), "actual"), F.concat(F.lit("expected: "), "expected"), F.concat(F.lit("evidence: "), F.array_join("paths", ", ")), F.concat(F.lit("claims: "), F.array_join("blocked_by", ", "))))
    return met.select("binding", F.array_join(lines, "\n").alias("note"))


def attestations(offered: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C-16: (records to append, refused ones): a review (claim, reviewer, fingerprint) counts only for the claim's current state."""
    met = offered.join(claims.select("claim", F.col("fingerprint").alias("current")), "claim", "left")
    good = met.where("current = fingerprint").drop("current").withColumn("record", fingerprint("claim", "reviewer", "fingerprint"))
    bad = met.where("current is null or current <> fingerprint").select("claim", "reviewer", F.when(F.col("current").isNull(), "UNKNOWN_CLAIM").otherwise("REVIEW_STALE").alias("error"))
    return good, bad


def fragment_targets(proposed: DataFrame, inputs: DataFrame, owned: DataFrame, current: DataFrame) -> DataFrame:
    """C-27: (fragment, path, error): destinations that are declared inputs, owned by another fragment, or edited since they were written."""
    met = proposed.join(inputs.select("path", F.lit(True).alias("is_input")).distinct(), "path", "left").join(owned.select("path", F.col("fragment").alias("owner"), F.col("sha256").alias("written")), "path", "left").join(current.select("path", F.col("sha256").alias("now")), "path", "left")
    error = F.when(F.col("is_input"), "FRAGMENT_INPUT").when(F.col("owner").isNotNull() & (F.col("owner") != F.col("fragment")), "FRAGMENT_OWNED").when(F.col("now").isNotNull() & ~F.col("now").eqNullSafe(F.col("written")), "FRAGMENT_EDITED")
    return met.select("fragment", "path", error.alias("error"))


def producer_records(cells: DataFrame, files: DataFrame) -> DataFrame:
    """C-15: (path, record): a record for each notebook from its saved cells and the files' identities, to be confirmed."""
    good = cells.groupBy("path").agg(F.expr("bool_and(status in ('saved_outputs', 'not_code'))").alias("complete"), F.array_sort(F.collect_list(F.struct("ord", "source_hash", "outputs_hash"))).alias("cells"))
    return good.where("complete").join(files.select("path", "sha256"), "path").select("path", fingerprint("sha256", F.to_json("cells")).alias("record"))


def staged(columns: DataFrame, declared: DataFrame, metrics: DataFrame, existing: DataFrame) -> DataFrame:
    """C-23: (stage, name, error) of declarations about to be added, each checked now.

    ``columns`` (source, column, type) is what the sources hold, ``declared``
    (source, column, type) what they are declared to hold, ``metrics`` (name,
    source, field, expected_count, seen) the metrics with the rows their
    selection has now; ``existing`` (name) are the names in use.
    """
    held = columns.select("source", "column", F.col("type").alias("found"))
    kinds = declared.join(held, ["source", "column"], "left")
    source_error = F.when(F.col("found").isNull(), "MISSING_COLUMN").when((F.col("type") != "string") & (F.col("found") != F.col("type")) & ~((F.col("type") == "decimal") & (F.col("found") == "integer")), "COLUMN_TYPE")
    sources = kinds.select(F.lit("source").alias("stage"), F.concat_ws(".", "source", "column").alias("name"), source_error.alias("error"))
    met = metrics.join(declared.select("source", F.col("column").alias("field"), "type"), ["source", "field"], "left").join(existing.select("name", F.lit(True).alias("used")).distinct(), "name", "left")
    metric_error = F.when(F.col("used"), "NAME_CONFLICT").when(F.col("type").isNull(), "MISSING_COLUMN").when(F.col("type") == "string", "COLUMN_TYPE").when(F.coalesce("seen", F.lit(0)) == 0, "EMPTY_SELECTION").when(F.col("seen") != F.col("expected_count"), "RECORD_COUNT")
    return sources.unionByName(met.select(F.lit("metric").alias("stage"), "name", metric_error.alias("error")))


def rebuilt_draft(chosen: DataFrame, edges: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """C-26, U-04: (name, state, changed): chosen declarations after their inputs changed.

    ``edges`` (src, dst) go from a declaration to what it needs, ``before`` and
    ``after`` (name, fingerprint) are the inputs on both sides.  A choice is
    kept, is to be checked again because an input of it changed, or is lost
    because one is gone; ``changed`` lists these inputs.
    """
    need = graphs.closure(edges, chosen.select(F.col("name").alias("root"))).select(F.col("root").alias("choice"), F.col("node").alias("name"))
    moved = states.declaration_diff(before, after, ["name"]).where("change <> 'added'").select("name", "change")
    hit = need.join(moved, "name").groupBy("choice").agg(F.array_sort(F.collect_set("name")).alias("changed"), F.max((F.col("change") == "removed").cast("int")).alias("gone"))
    out = chosen.select("name").join(hit.withColumnRenamed("choice", "name"), "name", "left")
    return out.select("name", F.when(F.col("changed").isNull(), "kept").when(F.col("gone") == 1, "lost").otherwise("check_again").alias("state"), F.coalesce("changed", F.array().cast("array<string>")).alias("changed"))
