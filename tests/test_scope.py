import random
from decimal import Decimal

from pyspark.sql import functions as F

from concordat.functions import lexeme as lx
from concordat.operators import provenance, textscan
from concordat.plans import check as ck
from concordat.plans import scope
from concordat.sources import sinks

SPANS = "ord long, doc_id long, start int, end int"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_first_come_agrees_with_one_after_the_other(spark):
    r = random.Random(3)
    rows = []
    for i in range(300):
        start = r.randint(0, 400)
        rows.append((i, r.randint(0, 2), start, start + r.randint(0, 30)))
    rows += [(1000 + i, 9, 10 * i, 10 * i + 15) for i in range(12)]  # one chain
    standing = []
    for o, d, s, e in rows:
        if not any(d == d2 and s < e2 and s2 < e and s < e and s2 < e2 for _, d2, s2, e2 in standing):
            standing.append((o, d, s, e))
    got = {x.ord for x in scope.first_come(spark.createDataFrame(rows, SPANS)).collect()}
    assert got == {x[0] for x in standing}
    assert scope.first_come(spark.createDataFrame([], SPANS)).count() == 0


def test_an_exclusion_that_is_not_active_stops_no_other(spark):
    d = docs(spark, "one 12345 two")
    raw = spark.createDataFrame([(1, 0, 4, 9), (2, 0, 4, 9), (3, 0, 4, 9)], SPANS)
    marked = ck.context_hash(d, raw).withColumn("context_hash", F.when(F.col("ord") == 1, "old").otherwise(F.col("context"))).drop("context")
    none = spark.createDataFrame([], "doc_id long, start int, end int")
    assert {x.ord: x.error for x in ck.active_exclusions(d, none, marked).collect()} == {1: "EXCLUSION_CHANGED", 2: None, 3: "EXCLUSION_OVERLAP"}


def test_exclusions_in_turn_and_by_joins_agree(spark):
    """a document's exclusions are judged in one pass; documents with more marks than a task takes are joined, with the same errors."""
    r = random.Random(5)
    d = docs(spark, "a" * 500, "b" * 500, "c" * 500)
    spans = [(i, r.choice([0, 1, 2, 7]), s, s + r.randint(0, 30)) for i, s in enumerate(r.randint(0, 400) for _ in range(200))]
    r.shuffle(spans)
    spans += [(900, None, 3, 9), (901, 0, None, 9), (902, 0, 450, 460)]
    edges = [(r.choice([0, 1, None]), s, s + r.randint(0, 20)) for s in (r.randint(0, 440) for _ in range(12))] + [(0, 455, 2**20)]
    marked = ck.context_hash(d, spark.createDataFrame(spans, SPANS)).withColumn("context_hash", F.when(F.col("ord") % 3 == 0, "old").otherwise(F.col("context"))).drop("context").withColumn("tags", F.array(F.col("ord").cast("string")))
    bound = spark.createDataFrame(edges, "doc_id long, start long, end long")
    meet = lambda s, e, others: any(s < e2 and s2 < e and s < e and s2 < e2 for s2, e2 in others)
    want, active = {}, {}
    for x in sorted(marked.collect(), key=lambda x: x.ord):
        span = (x.start, x.end) if x.start is not None and x.doc_id is not None else (0, 0)
        own = active.setdefault(x.doc_id, [])
        fresh = x.context_hash != "old"
        want[x.ord] = "EXCLUSION_BOUND" if meet(*span, [y[1:] for y in edges if y[0] == x.doc_id]) else "EXCLUSION_OVERLAP" if meet(*span, own) else None if fresh else "EXCLUSION_CHANGED"
        if want[x.ord] is None:
            own.append(span)
    assert set(want.values()) == {None, "EXCLUSION_BOUND", "EXCLUSION_OVERLAP", "EXCLUSION_CHANGED"}
    for most in (0, 60, scope.MOST_MARKS):
        got = ck.active_exclusions(d, bound, marked, most)
        assert got.columns == [*marked.columns, "error"] and [f.dataType for f in got.schema][:-1] == [f.dataType for f in marked.schema]
        rows = got.collect()
        assert len(rows) == len(want) and {x.ord: x.error for x in rows} == want, most
        assert all(x.tags == [str(x.ord)] for x in rows)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_numbers_in_nested_regions_are_blocked_without_merging(spark):
    """F12, F16: regions of several kinds over one number block it once; they aren't sorted and merged first."""
    d = docs(spark, "% a \\label{x1} $$ 2 $$ `3`\n4 and <!-- 5 `6` --> 7", "1 \\def 2", "8 % 9", None)
    tokens = textscan.number_tokens(d)
    kept = textscan.checkable(d, tokens)
    assert {(x.doc_id, x.token) for x in kept.collect()} == {(0, "4"), (0, "7"), (2, "8")}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "rangepartitioning" not in plan


def test_scope_by_files_and_regions(spark):
    d = docs(spark, "\\begin{abstract}a 1\\end{abstract} b 2", "c 3", None)
    spans = spark.createDataFrame([(0, 18, 19), (0, 37, 38), (1, 2, 3)], "doc_id long, start int, end int")
    files = spark.createDataFrame([(0,), (7,)], "doc_id long")
    places = lambda df: {(x.doc_id, x.start) for x in df.collect()}
    assert places(scope.selected(d, spans)) == {(0, 18), (0, 37), (1, 2)}
    assert places(scope.selected(d, spans, files)) == {(0, 18), (0, 37)}
    assert places(scope.selected(d, spans, None, ("abstract",))) == {(0, 18)}
    assert places(scope.selected(d, spans, files, ("table",))) == set()
    errors = lambda *a: {(x.subject, x.error) for x in scope.scope_errors(d, *a).collect()}
    assert errors(files, ("abstract",)) == {("7", "SCOPE_SELECTION")}
    assert errors(files.where("doc_id = 0"), ("abstract",)) == set()
    assert errors(None, ("table", "chapter")) == {("chapter", "SCOPE_SELECTION"), ("scope", "SCOPE_EMPTY")}


def test_exclusions_move_with_their_numbers(spark):
    far = "z" * 100
    old, new = docs(spark, f"{far} 41 {far}", "7 and 7", "5 here"), docs(spark, f"more words {far} 41 {far}", "7 and 7", "6 here")
    raw = spark.createDataFrame([(1, 0, 101, 103), (2, 1, 0, 1), (3, 2, 0, 1)], SPANS)
    marked = ck.context_hash(old, raw).withColumnRenamed("context", "context_hash")
    got = {x.ord: (x.start, x.end, x.anchor_error) for x in scope.moved(new, marked).collect()}
    assert got[1] == (112, 114, None) and got[2] == (0, 1, "ANCHOR_AMBIGUOUS") and got[3][2] == "EXCLUSION_STALE"


def test_change_of_exclusions(spark):
    d = docs(spark, "a 11 b 22 c 33")
    none = spark.createDataFrame([], "doc_id long, start int, end int")
    declared = spark.createDataFrame([], "name string, ord long, doc_id long, start int, end int, reason string, context_hash string")
    schema = "name string, ord long, action string, doc_id long, start int, end int, reason string"
    first = [("a", 1, "exclude", 0, 2, 4, "year"), ("b", 2, "exclude", 0, 2, 4, "same place"), ("c", 3, "exclude", 0, 3, 4, "part"), ("d", 4, "exclude", 0, 7, 9, None), ("e", 5, "remove", None, None, None, None), ("f", 6, "exclude", 0, 7, 9, "x"), ("f", 7, "remove", None, None, None, None), ("g", 8, None, 0, 7, 9, "x")]
    after, refused = scope.change_exclusions(d, none, declared, spark.createDataFrame(first, schema))
    assert {(x.name, x.active) for x in after.collect()} == {("a", True)}
    assert {(x.name, x.error, x.why) for x in refused.distinct().collect()} == {("b", "EXCLUSION_INVALID", "EXCLUSION_OVERLAP"), ("c", "BUILDER_SELECTION", None), ("d", "EXCLUSION_SCHEMA", None), ("e", "EXCLUSION_MISSING", None), ("f", "SCOPE_ACTION", None), ("g", "SCOPE_ACTION", None)}
    again = [("a", 1, "remove", None, None, None, None), ("b", 2, "exclude", 0, 2, 4, "same place"), ("h", 3, "exclude", 0, 12, 14, "x")]
    after, refused = scope.change_exclusions(d, none, after.drop("active"), spark.createDataFrame(again, schema))
    assert sorted((x.name, x.ord, x.active) for x in after.collect()) == [("b", 2, True), ("h", 3, True)] and refused.count() == 0


def test_fragment_texts(spark):
    spec = "fragment string, format string, layout string, language string, path string"
    specs = spark.createDataFrame([("t", "latex", "table", "en", "t.tex"), ("m", "markdown", "table", "zh-CN", "m.md"), ("v", "markdown", "value", "en", "v.md"), ("two", "latex", "value", "en", "w.tex"), ("big", "latex", "table", "en", "b.tex"), ("none", "latex", "table", "en", "n.tex"), ("kind", "html", "table", "en", "k.html"), ("end", "latex", "table", "en", "e.md"), ("null", None, "table", "en", None)], spec)
    values = [("t", 2, "a_b", "1.0 \\pm 0.1"), ("t", 1, "c", "50\\%"), ("m", 1, "a_b", "1 \\pm 2\\%"), ("v", 1, "x", "7\\%"), ("two", 1, "x", "1"), ("two", 2, "y", "1"), ("end", 1, "x", "1"), ("null", 1, "x", "1")] + [("big", i, f"o{i}", "1") for i in range(129)]
    got = {x.fragment: (x.text, x.error) for x in sinks.fragment_texts(specs, spark.createDataFrame(values, "fragment string, ord long, occurrence string, rendered string")).collect()}
    assert got["t"] == ("\\begin{tabular}{lr}\nBinding & Value \\\\\nc & 50\\% \\\\\na\\_b & \\ensuremath{1.0 \\pm 0.1} \\\\\n\\end{tabular}\n", None)
    assert got["m"] == ("| 绑定 | 数值 |\n| --- | ---: |\n| a\\_b | 1 ± 2% |\n", None) and got["v"] == ("7%\n", None)
    assert {k: e for k, (t, e) in got.items() if t is None} == {"two": "FRAGMENT_SELECTION", "big": "FRAGMENT_SELECTION", "none": "FRAGMENT_SELECTION", "kind": "FRAGMENT_SPEC", "end": "FRAGMENT_EXTENSION", "null": "FRAGMENT_SPEC"}


def test_figures_without_a_sound_record_are_unknown(spark):
    figures = spark.createDataFrame([("ok", "a", "ra"), ("gone", "z", "ra"), ("bare", "a", None), ("lost", "a", "rz"), ("other", "b", "ra"), ("edited", "b", "rb"), ("input", "c", "rc")], "figure string, path string, record string")
    records = spark.createDataFrame([("ra", "a", "1"), ("rb", "b", "0"), ("rc", "c", "1")], "record string, path string, output_hash string")
    inputs = spark.createDataFrame([("ra", "i", "1"), ("rb", "i", "1"), ("rb", "j", "0"), ("rc", "k", "1")], "record string, path string, recorded string")
    current = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("i", "1"), ("j", "1"), ("k", "unavailable:FILE_UNAVAILABLE")], "path string, identity string")
    got = {x.figure: (x.status, x.error, x.changed_paths) for x in provenance.figure_states(figures, records, inputs, current).collect()}
    assert got == {"ok": ("pass", None, []), "gone": ("unknown", "FILE_UNAVAILABLE", []), "bare": ("unknown", "PROVENANCE_UNKNOWN", []), "lost": ("unknown", "FILE_UNAVAILABLE", []), "other": ("unknown", "FIGURE_RECORD", []), "edited": ("mismatch", "FIGURE_CHANGED", ["j", "b"]), "input": ("unknown", "FILE_UNAVAILABLE", [])}


def test_producers_of_both_kinds(spark):
    specs = spark.createDataFrame([("n", "notebook", "n.ipynb"), ("q", "quarto", "q.QMD"), ("cells", "quarto", "c.qmd"), ("empty", "notebook", "e.ipynb"), ("name", "quarto", "n.md"), ("lost", "notebook", "n.ipynb"), ("count", "notebook", "n.ipynb"), ("open", "notebook", "n.ipynb"), ("twice", "quarto", "q.qmd"), ("odd", None, None)], "record string, kind string, source string")
    paths = spark.createDataFrame([(r, s, "1") for r, _, s in specs.collect() if s] + [("twice", "q.qmd", "1")], "record string, path string, recorded string")
    cells = spark.createDataFrame([("n", "1", "s", "o", 1), ("cells", "1", "s", "o", 1), ("lost", "9", "s", "o", 1), ("count", "1", "s", "o", 2), ("open", "2", "s", "x", None)], "record string, cell_id string, source_hash string, outputs_hash string, execution_count long")
    scanned = spark.createDataFrame([("n.ipynb", "1", "s", "o", 1, "saved_outputs"), ("n.ipynb", "2", "s", "o", None, "unexecuted"), ("n.ipynb", "9", "s", "o", 1, "not_code")], "path string, cell_id string, source_hash string, outputs_hash string, execution_count long, status string")
    current = paths.select("path", F.lit("1").alias("identity")).distinct()
    got = {x.record: (x.status, x.error) for x in provenance.producer_states(specs, paths, cells, current, scanned).collect()}
    wrong = ("unknown", "PROVENANCE_SPEC")
    assert got == {"n": ("pass", None), "q": ("pass", None), "cells": wrong, "empty": wrong, "name": wrong, "lost": ("unknown", "PROVENANCE_CELLS"), "count": ("mismatch", "PRODUCER_STALE"), "open": ("unknown", "NOTEBOOK_OUTPUT_UNVERIFIED"), "twice": wrong, "odd": wrong}


def test_plain_decimals_of_any_length(spark):
    def shown(x):
        text = format(Decimal(x), "f")
        text = text.rstrip("0").rstrip(".") if "." in text else text
        return "0" if text in ("0", "-0") else text

    r = random.Random(1)
    rows = ["0", "-0.00", "1e5", "-1.50e-3", "+.5", "5.", "-0e9", "100", "00012.300", "1e1000", "9" * 1024, "1E-40"]
    for _ in range(200):
        m = "".join(r.choice("0123456789") for _ in range(r.randint(1, 60)))
        k = r.randint(0, len(m))
        rows.append(r.choice(["", "-", "+"]) + (m[:k] + "." + m[k:] if 0 < k < len(m) else m) + r.choice(["", f"e{r.randint(-80, 80)}"]))
    out = {x.t: x.p for x in spark.createDataFrame([(x,) for x in rows], "t string").select("t", lx.plain_decimal("t").alias("p")).collect()}
    assert {x: out[x] for x in rows} == {x: shown(x) for x in rows}
    bad = spark.createDataFrame([("x",), ("1e1001",), (None,), ("nan",)], "t string")
    assert [x.p for x in bad.select(lx.plain_decimal("t").alias("p")).collect()] == [None] * 4
    assert [x.j for x in bad.select(lx.exact_json({"a": (F.col("t"), "decimal")}).alias("j")).collect()] == [None, None, '{"a":null}', None]
