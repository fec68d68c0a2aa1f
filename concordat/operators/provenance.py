"""Recorded identities against current ones: figures, producers, fragments, exports and saved definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def identities(expected: DataFrame, files: DataFrame) -> DataFrame:
    """S-15: (path, identity): the sha256 of each expected path, or ``unavailable:FILE_UNAVAILABLE``; absence is an identity too."""
    return expected.select("path").distinct().join(files.select("path", "sha256"), "path", "left").select("path", F.coalesce("sha256", F.lit("unavailable:FILE_UNAVAILABLE")).alias("identity"))


def input_states(inputs: DataFrame, current: DataFrame) -> DataFrame:
    """J-11, J-12: adds ``state`` to recorded inputs (record, path, recorded) by (path, identity): same, changed or missing."""
    gone = F.col("identity").isNull() | F.col("identity").startswith("unavailable:")
    return inputs.join(current, "path", "left").select("record", "path", F.when(gone, "missing").when(F.col("identity") != F.col("recorded"), "changed").otherwise("same").alias("state"))


def record_states(inputs: DataFrame, current: DataFrame) -> DataFrame:
    """J-11, J-12, J-19: (record, status, changed, missing): how many inputs of each record differ from or lack their identities.

    An input that can't be read makes the record unknown, which outweighs a
    mismatch.  The paths themselves are the rows of ``input_states``.
    """
    n = input_states(inputs, current).groupBy("record").agg(F.count_if(F.col("state") == "changed").alias("changed"), F.count_if(F.col("state") == "missing").alias("missing"))
    return n.select("record", F.when(F.col("missing") > 0, "unknown").when(F.col("changed") > 0, "mismatch").otherwise("pass").alias("status"), "changed", "missing")


def producer_cells(records: DataFrame, cells: DataFrame) -> DataFrame:
    """J-12: (record, status): recorded notebook cells (record, path, cell_id, source_hash, outputs_hash) against scanned ones."""
    met = records.join(cells.select("path", "cell_id", F.col("source_hash").alias("s"), F.col("outputs_hash").alias("o"), F.col("status").alias("cell_status")), ["path", "cell_id"], "left")
    bad = F.col("s").isNull() | (F.col("cell_status") != "saved_outputs")
    differs = (F.col("s") != F.col("source_hash")) | (F.col("o") != F.col("outputs_hash"))
    out = met.groupBy("record").agg(F.max(bad.cast("int")).alias("bad"), F.max(F.coalesce(differs, F.lit(False)).cast("int")).alias("differs"))
    return out.select("record", F.when(F.col("bad") == 1, "unknown").when(F.col("differs") == 1, "mismatch").otherwise("pass").alias("status"))


def export_states(states: DataFrame, exports: DataFrame) -> DataFrame:
    """J-10, A-20, C-13: (file, source, metric, status) of metrics bound in an export (file) and in its source.

    ``states`` has file, metric, status.  aligned: all pass on both sides;
    stale: the source passes only; source_outdated: the source doesn't;
    unknown: a side is missing or undecided.
    """
    side = states.groupBy("file", "metric").agg(F.expr("bool_and(status = 'pass')").alias("ok"), F.expr("bool_or(status = 'unknown')").alias("open"))
    left = exports.join(side.withColumnRenamed("file", "source"), "source").select("file", "source", "metric", F.col("ok").alias("s_ok"), F.col("open").alias("s_open"))
    right = exports.join(side, "file").select("file", "source", "metric", F.col("ok").alias("e_ok"), F.col("open").alias("e_open"))
    met = left.join(right, ["file", "source", "metric"], "full")
    undecided = F.col("s_ok").isNull() | F.col("e_ok").isNull() | F.col("s_open") | F.col("e_open")
    status = F.when(undecided, "unknown").when(F.col("s_ok") & F.col("e_ok"), "aligned").when(F.col("s_ok"), "stale").otherwise("source_outdated")
    bare = exports.join(states.select("file").distinct(), "file", "left_anti").join(states.select(F.col("file").alias("source")).distinct(), "source", "left_anti")
    return met.select("file", "source", "metric", status.alias("status")).unionByName(bare.select("file", "source", F.lit(None).cast("string").alias("metric"), F.lit("unknown").alias("status")))


def contract_matches(saved: DataFrame, sources: DataFrame) -> DataFrame:
    """J-27, C-20: (definition, source, matches) of saved definitions and the source each names: format and key equal, and every saved column declared with the same type."""
    met = saved.join(sources.select("source", F.col("format").alias("f"), F.col("primary_key").alias("k"), F.col("columns").alias("c")), "source")
    inside = F.forall(F.map_entries("columns"), lambda e: F.coalesce(F.try_element_at("c", e["key"]) == e["value"], F.lit(False)))
    same = (F.col("format") == F.col("f")) & (F.array_sort("primary_key") == F.array_sort("k")) & inside
    return met.select("definition", "source", same.alias("matches"))


def conflicting_inputs(hashes: DataFrame) -> DataFrame:
    """U-08: paths that come with more than one hash."""
    return hashes.groupBy("path").agg(F.count_distinct("sha256").alias("n")).where("n > 1").select("path", F.lit("INPUT_CONFLICT").alias("error"))


def timestamps(records: DataFrame) -> DataFrame:
    """F-38: (record, error): started, finished and recorded must be ISO times with a zone, in this order."""
    zoned = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
    times = {c: F.when(F.col(c).rlike(zoned), F.try_to_timestamp(F.col(c))) for c in ("started", "finished", "recorded")}
    bad = times["started"].isNull() | times["finished"].isNull() | times["recorded"].isNull()
    error = F.when(bad, "TIMESTAMP_ZONE").when((times["finished"] < times["started"]) | (times["recorded"] < times["finished"]), "TIMESTAMP_ORDER")
    return records.select("record", error.alias("error"))


# -- lanes of C-14 --------------------------------------------------------

# The file name that each kind of producer has, and what a fragment's record names beside its files.
PRODUCER_SUFFIX = {"notebook": ".ipynb", "quarto": ".qmd"}


def _inputs_by_record(inputs: DataFrame, current: DataFrame) -> DataFrame:
    """(record, n, differ, gone, changed_paths): recorded inputs of each record against current identities.

    ``changed_paths`` is as long as the record's own list of inputs.
    """
    state = input_states(inputs, current)
    named = F.array_sort(F.collect_set(F.when(F.col("state") == "changed", F.col("path"))))
    return state.groupBy("record").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "changed").alias("differ"), F.count_if(F.col("state") == "missing").alias("gone"), named.alias("changed_paths"))


def figure_states(figures: DataFrame, records: DataFrame, inputs: DataFrame, current: DataFrame) -> DataFrame:
    """J-11, C-14: (figure, status, provenance, error, changed_paths) of declared figures.

    ``figures`` has figure, path and record (null where none is declared),
    ``records`` record, path and output_hash, ``inputs`` (record, path,
    recorded) what each record says of its inputs and script, ``current``
    (path, identity) what is there now.  A figure is unknown where its file,
    its record or one of the inputs can't be read, where it has no record
    (PROVENANCE_UNKNOWN) or where the record is of another path
    (FIGURE_RECORD); it mismatches where an input, the script or the figure
    itself is no longer what was recorded.
    """
    readable = current.where(~F.col("identity").startswith("unavailable:"))
    own = figures.join(readable.select("path", F.col("identity").alias("actual")), "path", "left")
    told = records.select("record", F.col("path").alias("told_path"), "output_hash")
    met = own.join(told, "record", "left").join(_inputs_by_record(inputs, readable), "record", "left")
    error = (
        F.when(F.col("actual").isNull(), "FILE_UNAVAILABLE")
        .when(F.col("record").isNull(), "PROVENANCE_UNKNOWN")
        .when(F.col("told_path").isNull(), "FILE_UNAVAILABLE")
        .when(F.col("told_path") != F.col("path"), "FIGURE_RECORD")
        .when(F.coalesce("gone", F.lit(0)) > 0, "FILE_UNAVAILABLE")
    )
    none = F.array().cast("array<string>")
    itself = F.when(~F.col("actual").eqNullSafe(F.col("output_hash")), F.array("path")).otherwise(none)
    changed = F.when(error.isNull(), F.concat(F.coalesce("changed_paths", none), itself)).otherwise(none)
    out = met.select("figure", error.alias("error"), changed.alias("changed_paths"))
    moved = F.size("changed_paths") > 0
    status = F.when(F.col("error").isNotNull(), "unknown").when(moved, "mismatch").otherwise("pass")
    since = F.when(F.col("error").isNotNull(), "unknown").when(moved, "dependency_changed").otherwise("unchanged_since_record")
    return out.select("figure", status.alias("status"), since.alias("provenance"), F.coalesce("error", F.when(moved, "FIGURE_CHANGED")).alias("error"), "changed_paths")


def producer_states(specs: DataFrame, paths: DataFrame, cells: DataFrame, current: DataFrame, scanned: DataFrame) -> DataFrame:
    """J-12, C-14: (record, kind, status, error, changed_paths, changed_cells, unverified_cells) of notebooks and Quarto documents.

    ``specs`` has record, kind and source; ``paths`` (record, path, recorded)
    holds source, inputs and outputs; ``cells`` (record, cell_id, source_hash,
    outputs_hash, execution_count) what was recorded of a notebook, ``scanned``
    (path, cell_id, cell_type or status, source_hash, outputs_hash,
    execution_count) what the notebooks hold now.  Only a notebook has cells,
    and it has at least one; its source is named ``.ipynb``, that of a Quarto
    document ``.qmd``, which is known by its files alone.  A path that can't be
    read, a cell that is gone, or one without saved outputs leaves the record
    unknown, which outweighs a change.
    """
    readable = current.where(~F.col("identity").startswith("unavailable:"))
    files = _inputs_by_record(paths, readable)
    twice = paths.groupBy("record", "path").agg(F.count(F.lit(1)).alias("k")).groupBy("record").agg(F.max("k").alias("most"))
    now = scanned.where("status <> 'not_code'").select(F.col("path").alias("source"), "cell_id", F.col("source_hash").alias("s"), F.col("outputs_hash").alias("o"), F.col("execution_count").alias("x"), "status")
    held = cells.join(specs.select("record", "source"), "record").join(now, ["source", "cell_id"], "left")
    differs = ~(F.col("s").eqNullSafe(F.col("source_hash")) & F.col("o").eqNullSafe(F.col("outputs_hash")) & F.col("x").eqNullSafe(F.col("execution_count")))
    there = F.col("status").isNotNull()
    by_cell = held.groupBy("record").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(~there).alias("lost"),
        F.array_sort(F.collect_set(F.when(there & differs, F.col("cell_id")))).alias("changed_cells"),
        F.array_sort(F.collect_set(F.when(there & (F.col("status") != "saved_outputs"), F.col("cell_id")))).alias("unverified_cells"),
    )
    met = specs.join(files, "record", "left").join(twice, "record", "left").join(by_cell, "record", "left")
    suffix = F.create_map(*[F.lit(x) for pair in PRODUCER_SUFFIX.items() for x in pair])[F.col("kind")]
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, none) for c in ("changed_paths", "changed_cells", "unverified_cells")}
    wrong = suffix.isNull() | ~F.lower("source").endswith(suffix) | ((F.col("kind") == "notebook") != F.coalesce(F.col("cells") > 0, F.lit(False))) | (F.coalesce("most", F.lit(0)) != 1)
    error = (
        F.when(F.coalesce(wrong, F.lit(True)), "PROVENANCE_SPEC")
        .when(F.col("gone") > 0, "FILE_UNAVAILABLE")
        .when(F.col("lost") > 0, "PROVENANCE_CELLS")
        .when(F.size(lists["unverified_cells"]) > 0, "NOTEBOOK_OUTPUT_UNVERIFIED")
        .when((F.size(lists["changed_paths"]) > 0) | (F.size(lists["changed_cells"]) > 0), "PRODUCER_STALE")
    )
    status = F.when(error == "PRODUCER_STALE", "mismatch").when(error.isNotNull(), "unknown").otherwise("pass")
    return met.select("record", "kind", status.alias("status"), error.alias("error"), *[v.alias(k) for k, v in lists.items()])


def fragment_states(records: DataFrame, recorded: DataFrame, rendered: DataFrame, inputs: DataFrame, current: DataFrame) -> DataFrame:
    """J-19, C-14: (fragment, status, error, changed_paths, contract_changed, values_changed, output_changed) of generated fragments.

    ``records`` has fragment, path, contract, values_hash and output_hash, all
    as recorded; ``recorded`` (fragment, path, recorded) the inputs of that
    time; ``rendered`` (fragment, contract, values_hash, content_hash) and
    ``inputs`` (fragment, path, identity) what rendering gives now; ``current``
    (path, identity) the files.  A fragment mismatches where an input was added,
    dropped or changed, where the declarations or the values behind it differ,
    where its file was edited, or where rendering gives other text than the
    file has.  It is unknown where its file can't be read or where nothing could
    be rendered.
    """
    before, after = recorded.select("fragment", "path", "recorded"), inputs.select("fragment", "path", F.col("identity").alias("now"))
    moved = before.join(after, ["fragment", "path"], "full").where(~F.col("recorded").eqNullSafe(F.col("now"))).groupBy("fragment").agg(F.array_sort(F.collect_set("path")).alias("moved"))
    file = current.where(~F.col("identity").startswith("unavailable:")).select("path", F.col("identity").alias("actual"))
    fresh = rendered.select("fragment", F.col("contract").alias("contract_now"), F.col("values_hash").alias("values_now"), "content_hash")
    met = records.join(file, "path", "left").join(fresh, "fragment", "left").join(moved, "fragment", "left")
    none = F.array().cast("array<string>")
    edited = ~F.col("actual").eqNullSafe(F.col("output_hash"))
    lost = F.when(F.col("actual").isNull(), "FILE_UNAVAILABLE").when(F.col("content_hash").isNull(), "FRAGMENT_SELECTION")
    flags = {
        "contract_changed": ~F.col("contract").eqNullSafe(F.col("contract_now")),
        "values_changed": ~F.col("values_hash").eqNullSafe(F.col("values_now")),
        "output_changed": edited | ~F.col("content_hash").eqNullSafe(F.col("actual")),
    }
    paths = F.concat(F.coalesce("moved", none), F.when(edited, F.array("path")).otherwise(none))
    out = met.select("fragment", lost.alias("lost"), F.when(lost.isNull(), paths).otherwise(none).alias("changed_paths"), *[(lost.isNull() & v).alias(k) for k, v in flags.items()])
    stale = (F.size("changed_paths") > 0) | F.col("contract_changed") | F.col("values_changed") | F.col("output_changed")
    status = F.when(F.col("lost").isNotNull(), "unknown").when(stale, "mismatch").otherwise("pass")
    return out.select("fragment", status.alias("status"), F.coalesce("lost", F.when(stale, "FRAGMENT_STALE")).alias("error"), "changed_paths", *flags)
