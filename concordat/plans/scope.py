"""C-24: what a review covers, and the numbers it leaves out with a reason; changed only where the change still holds after a new check."""

from __future__ import annotations

from bisect import bisect_left
from functools import partial

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from concordat.functions.lexeme import sha256
from concordat.operators import intervals, textscan
from concordat.operators.scratch import Scratch

# Kinds of regions that a scope may name, and what may be asked for an exclusion.
REGIONS = tuple(textscan.PRIORITY)
ACTIONS = ("exclude", "remove")


def scope_regions(documents: DataFrame, files: DataFrame | None, kinds: tuple[str, ...]) -> DataFrame:
    """(doc_id, kind, start, end): the regions of the given kinds in the documents of a scope; ``files`` (doc_id) is None for all."""
    chosen = documents if files is None else documents.join(files.select("doc_id").distinct(), "doc_id", "left_semi")
    return textscan.regions(chosen, {k: textscan.PRIORITY[k] for k in kinds if k in textscan.PRIORITY})


def scope_errors(documents: DataFrame, files: DataFrame | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(subject, error) of what a scope names and the documents lack; no row where the scope holds.

    A file that is no document, or an unknown kind, is SCOPE_SELECTION.  Kinds
    of which the chosen documents have no region at all are SCOPE_EMPTY: a
    typing error must not look like a complete review.
    """
    spark = documents.sparkSession
    schema = "subject string, error string"
    out = spark.createDataFrame([(k, "SCOPE_SELECTION") for k in kinds if k not in REGIONS], schema)
    if files is not None:
        lost = files.select("doc_id").distinct().join(documents.select("doc_id"), "doc_id", "left_anti")
        out = out.unionByName(lost.select(F.col("doc_id").cast("string").alias("subject"), F.lit("SCOPE_SELECTION").alias("error")))
    if any(k in REGIONS for k in kinds):
        n = scope_regions(documents, files, kinds).limit(1).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(n.where("n = 0").select(F.lit("scope").alias("subject"), F.lit("SCOPE_EMPTY").alias("error")))
    return out


def selected(documents: DataFrame, spans: DataFrame, files: DataFrame | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """P-13: (doc_id, start, end), without repeats: the spans that lie in a chosen document and, where kinds are named, wholly inside one of their regions."""
    keys = spans.select("doc_id", "start", "end").distinct()
    if files is not None:
        keys = keys.join(files.select("doc_id").distinct(), "doc_id", "left_semi")
    if not kinds:
        return keys
    places = scope_regions(documents, files, kinds).select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return intervals.contained_in(keys, places).select("doc_id", "start", "end").distinct()


def first_come(spans: DataFrame) -> DataFrame:
    """(ord) of the spans (ord, doc_id, start, end) that stand when each yields to earlier standing ones that it overlaps.

    A span that has yielded itself stops nobody.  Each round lets those stand
    that no open earlier span overlaps, and drops what overlaps them, so the
    rounds are as many as the longest chain of spans that depend on each other;
    without overlaps there is none.
    """
    key = ["ord", "doc_id", "start", "end"]
    other = spans.select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("ord").alias("earlier"))
    met = intervals.overlap_join(spans.select(*key), other).where("earlier < ord").select("ord", "earlier").distinct()
    scratch = Scratch(spans.sparkSession, "first-come")
    open_ = scratch.save(met, "pairs-0")
    dropped = None
    turn = 0
    while not open_.isEmpty():
        waiting = open_.select("ord").distinct()
        stands = open_.select(F.col("earlier").alias("ord")).distinct().join(waiting, "ord", "left_anti")
        out = scratch.save(open_.join(stands.withColumnRenamed("ord", "earlier"), "earlier", "left_semi").select("ord").distinct(), f"out-{turn}")
        dropped = out if dropped is None else dropped.unionByName(out)
        left = open_.join(out, "ord", "left_anti").join(out.withColumnRenamed("ord", "earlier"), "earlier", "left_anti")
        turn += 1
        open_ = scratch.save(left.select("ord", "earlier"), f"pairs-{turn}")
    every = spans.select("ord")
    return every if dropped is None else every.join(dropped, "ord", "left_anti")


def context_hash(documents: DataFrame, spans: DataFrame, size: int = 80) -> DataFrame:
    """F-31: adds ``context`` of spans (doc_id, start, end), the sha256 of the text from ``size`` characters before to ``size`` behind."""
    met = spans.join(documents.select("doc_id", "text"), "doc_id", "left")
    low = F.greatest(F.lit(0), F.col("start") - size)
    return met.withColumn("context", sha256(F.substring("text", low + 1, F.col("end") + size - low))).drop("text")


#: Marks of one document that a task takes in turn; in documents with more they are joined.
MOST_MARKS = 100_000


def active_exclusions(documents: DataFrame, bound: DataFrame, exclusions: DataFrame, most: int = MOST_MARKS) -> DataFrame:
    """J-20, C-24: adds ``error`` to exclusions: EXCLUSION_BOUND, EXCLUSION_OVERLAP or EXCLUSION_CHANGED.

    An exclusion yields to earlier ones (by ``ord``, which is unique) that are
    active; one that is bound, changed or has yielded itself stops no other.
    Documents are dealt to tasks, which take each one's exclusions in order;
    those of a document with more than ``most`` marks meet by overlap joins.
    """
    scratch = Scratch(documents.sparkSession, "active")
    fresh = F.col("context").eqNullSafe(F.col("context_hash"))
    met = context_hash(documents, exclusions).select(*exclusions.columns, fresh.alias("_fresh"), F.lit(False).alias("_bound"))
    marks = scratch.save(met.unionByName(bound.select("doc_id", "start", "end", F.lit(True).alias("_bound")), allowMissingColumns=True), "marks")
    large = scratch.save(marks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("doc_id"), "large")
    # Places may be of a narrower type than those of bound spans.
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in exclusions.schema]
    if large.isEmpty():
        return _in_turn(marks, exclusions.columns).select(*columns, "error")
    out = _in_turn(marks.join(large, "doc_id", "left_anti"), exclusions.columns)
    return out.unionByName(_by_joins(marks.join(large, "doc_id", "left_semi"), exclusions.columns, scratch)).select(*columns, "error")


def _in_turn(marks: DataFrame, columns: list[str]) -> DataFrame:
    """``active_exclusions`` of whole documents, each in one task: its bound spans, then its exclusions in order."""
    ordered = marks.repartition("doc_id").sortWithinPartitions("doc_id", F.desc("_bound"), "ord", "start")
    fields = [StructField(c, marks.schema[c].dataType) for c in columns]
    return ordered.mapInArrow(partial(_judged, columns=columns), StructType([*fields, StructField("error", StringType())]))


def _meets(spans: tuple[list[int], list[int]], start: int, end: int) -> bool:
    """Whether a span overlaps one of the given ones (starts, ends), which are sorted and don't overlap."""
    before = bisect_left(spans[0], end)
    return before > 0 and spans[1][before - 1] > start


def _values(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _judged(batches, columns: list[str]):
    doc = None
    bound, active = ([], []), ([], [])
    for batch in batches:
        errors = []
        for d, is_bound, fresh, start, end in zip(*[_values(batch.column(c)) for c in ("doc_id", "_bound", "_fresh", "start", "end")], strict=True):
            if d != doc or d is None:
                doc, bound, active = d, ([], []), ([], [])
            placed = d is not None and start is not None and end is not None and start < end
            if is_bound:
                if placed and bound[0] and start <= bound[1][-1]:
                    bound[1][-1] = max(end, bound[1][-1])
                elif placed:
                    bound[0].append(start)
                    bound[1].append(end)
            elif placed and _meets(bound, start, end):
                errors.append("EXCLUSION_BOUND")
            elif placed and _meets(active, start, end):
                errors.append("EXCLUSION_OVERLAP")
            elif fresh:
                errors.append(None)
                if placed:
                    at = bisect_left(active[0], start)
                    active[0].insert(at, start)
                    active[1].insert(at, end)
            else:
                errors.append("EXCLUSION_CHANGED")
        kept = batch.filter(pa.compute.invert(batch.column("_bound")))
        yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in columns], pa.array(errors, pa.string())], [*columns, "error"])


def _by_joins(marks: DataFrame, columns: list[str], scratch: Scratch) -> DataFrame:
    """``active_exclusions`` of documents with any number of marks."""
    key = ["ord", "doc_id", "start", "end"]
    met, bound = marks.where("not _bound"), marks.where("_bound").select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    over = intervals.overlap_join(met.select(*key), bound).select("ord").distinct().withColumn("bound", F.lit(True))
    judged = scratch.save(met.select(*key, F.col("_fresh").alias("fresh")).join(over.hint("merge"), "ord", "left"), "judged")
    stands = first_come(judged.where("bound is null and fresh").select(*key)).withColumn("stands", F.lit(True))
    told = scratch.save(judged.join(stands.hint("merge"), "ord", "left"), "told")
    active = told.where("stands").select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("ord").alias("other"))
    # Of those that are bound or stand, the error is known; a fresh one that doesn't stand has yielded.
    stale = intervals.overlap_join(told.where("bound is null and not fresh").select(*key), active).where("other < ord").select("ord").distinct().withColumn("yields", F.lit(True))
    error = F.when(F.col("bound"), "EXCLUSION_BOUND").when(F.col("stands"), None).when(F.col("fresh") | F.col("yields"), "EXCLUSION_OVERLAP").otherwise("EXCLUSION_CHANGED")
    errors = told.join(stale.hint("merge"), "ord", "left").select("ord", error.alias("error"))
    return met.join(errors.hint("merge"), "ord").select(*columns, "error")


def moved(documents: DataFrame, exclusions: DataFrame, size: int = 80) -> DataFrame:
    """Exclusions at the places where their numbers stand now, with ``anchor_error``.

    A number's place is the one whose surrounding text has the recorded hash
    (``context_hash``), so text that was added far away moves an exclusion and
    doesn't end it.  EXCLUSION_STALE: no number has that surrounding any more;
    ANCHOR_AMBIGUOUS: several have it.
    """
    tokens = textscan.number_tokens(documents, context=0).select("doc_id", "start", "end")
    now = context_hash(documents, tokens, size).groupBy("doc_id", F.col("context").alias("context_hash")).agg(F.count(F.lit(1)).alias("_n"), F.min("start").alias("_start"), F.min("end").alias("_end"))
    met = exclusions.join(now, ["doc_id", "context_hash"], "left")
    one = F.col("_n") == 1
    place = {"start": F.when(one, F.col("_start")).otherwise(F.col("start")), "end": F.when(one, F.col("_end")).otherwise(F.col("end"))}
    error = F.when(F.col("_n").isNull(), "EXCLUSION_STALE").when(~one, "ANCHOR_AMBIGUOUS")
    return met.select(*[place[c].alias(c) if c in place else F.col(c) for c in exclusions.columns], error.alias("anchor_error"))


def change_exclusions(documents: DataFrame, bound: DataFrame, declared: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C-24: (declarations after the change, what was refused of it).

    ``declared`` has name, ord, doc_id, start, end, reason and context_hash,
    ``requests`` name, ord, action (exclude or remove), doc_id, start, end and
    reason.  A new exclusion needs a free name (EXCLUSION_EXISTS), a reason
    (EXCLUSION_SCHEMA) and a number that can be checked (BUILDER_SELECTION); it
    comes behind those there are, in the requests' order, and has to be active
    after a new check (EXCLUSION_INVALID).  A removal needs a declared name
    (EXCLUSION_MISSING).  Other actions, and names asked for more than once, are
    refused (SCOPE_ACTION).  What was declared stays, active or not, until it is
    removed.
    """
    once = requests.groupBy("name").agg(F.count(F.lit(1)).alias("_asked"))
    held = declared.select("name", F.lit(True).alias("_held")).distinct()
    scratch = Scratch(documents.sparkSession, "exclusions")
    # Read twice; of all numbers only those that are asked for can matter.
    places = requests.where("action = 'exclude'").select("doc_id", "start", "end").distinct()
    tokens = textscan.number_tokens(documents, context=0).select("doc_id", "start", "end")
    asked = scratch.save(tokens.join(places.hint("merge"), ["doc_id", "start", "end"], "left_semi"), "numbers")
    numbers = textscan.checkable(documents, asked).withColumn("_number", F.lit(True))
    met = requests.join(once, "name").join(held, "name", "left").join(numbers, ["doc_id", "start", "end"], "left")
    new, gone = F.col("action") == "exclude", F.col("action") == "remove"
    error = (
        F.when((F.col("_asked") > 1) | ~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "SCOPE_ACTION")
        .when(new & F.col("_held"), "EXCLUSION_EXISTS")
        .when(new & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "EXCLUSION_SCHEMA")
        .when(new & F.col("_number").isNull(), "BUILDER_SELECTION")
        .when(gone & F.col("_held").isNull(), "EXCLUSION_MISSING")
    )
    judged = scratch.save(met.select(*requests.columns, error.alias("error")), "judged")
    kept = declared.join(judged.where("error is null and action = 'remove'").select("name"), "name", "left_anti")
    last = declared.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("_last")).crossJoin(requests.agg(F.min("ord").alias("_first")))  # two single rows
    offered = judged.where("error is null and action = 'exclude'").crossJoin(F.broadcast(last))
    wanted = context_hash(documents, offered.select("name", (F.col("_last") + 1 + F.col("ord") - F.col("_first")).alias("ord"), "doc_id", "start", "end", "reason")).withColumnRenamed("context", "context_hash")
    columns = ["name", "ord", "doc_id", "start", "end", "reason", "context_hash"]
    both = kept.select(*columns, F.lit(False).alias("late")).unionByName(wanted.select(*columns, F.lit(True).alias("late")))
    checked = scratch.save(active_exclusions(documents, bound, both), "checked")
    after = checked.where("not late or error is null").select(*columns, F.col("error").isNull().alias("active"))
    invalid = checked.where("late and error is not null").select("name", F.lit("EXCLUSION_INVALID").alias("error"), F.col("error").alias("why"))
    refused = judged.where("error is not null").select("name", "error", F.lit(None).cast("string").alias("why"))
    return after, refused.unionByName(invalid)
