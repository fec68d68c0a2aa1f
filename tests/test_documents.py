import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from concordat.operators import graphs, intervals, suggest, tables, textscan
from concordat.plans import check as ck

NUMBER = re.compile(r"(?<![\w.])[+\-−]?(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)(?:[eE][+\-]?\d+)?(?!\w|\.\d)")


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


TEXTS = ["We get 84.1 % and 1,234 (v1.2.3) at 5e-3; −7 x2 3é .5", "", "no numbers", "12", "1 2 3 1", "漢字12漢 3.5。", "a 1.\nb 2%", "😀 7 😀 8"]


def test_number_tokens_have_python_s_offsets(spark):
    got = sorted((r.doc_id, r.start, r.end, r.token) for r in textscan.number_tokens(docs(spark, *TEXTS)).collect())
    assert got == sorted((i, m.start(), m.end(), m.group()) for i, t in enumerate(TEXTS) for m in NUMBER.finditer(t))
    native = {(r.doc_id, r.token) for r in textscan.number_tokens(docs(spark, *TEXTS), native=True).collect()}
    assert (5, "12") in native and (0, "1.2") not in native
    same = {(r.doc_id, r.token): r.same_text for r in textscan.repeats(textscan.number_tokens(docs(spark, *TEXTS))).collect()}
    assert same[4, "1"] == 2 and same[4, "2"] == 1


def naive(a, b):
    return {(x, y) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2]}


@pytest.mark.parametrize("width", [1, 7, 512])
def test_overlap_join_equals_the_naive_one(spark, width):
    rng = random.Random(width)
    a, b = ([(rng.randint(0, 2), s, s + rng.choice([0, 1, 5, 40])) for s in (rng.randint(0, 120) for _ in range(40))] for _ in range(2))
    a, b = list(dict.fromkeys(a)), list(dict.fromkeys(b))
    left = spark.createDataFrame(a, "doc_id long, start int, end int")
    right = spark.createDataFrame(b, "doc_id long, r_start int, r_end int")
    got = [((r.doc_id, r.start, r.end), (r.doc_id, r.r_start, r.r_end)) for r in intervals.overlap_join(left, right, width=width).collect()]
    assert len(got) == len(set(got)) and set(got) == naive(a, b)
    anti = {tuple(r) for r in intervals.overlap_join(left, right, width=width, how="left_anti").collect()}
    assert anti == set(a) - {x for x, _ in naive(a, b)}
    inside = {((r.doc_id, r.start, r.end), (r.doc_id, r.r_start, r.r_end)) for r in intervals.contained_in(left, right, width=width).collect()}
    assert inside == {(x, y) for x, y in naive(a, b) if y[1] <= x[1] and x[2] <= y[2]}


def test_union(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 3, 4), (1, 5, 7), (1, 9, 10), (2, 1, 2)], "doc_id long, start int, end int")
    assert sorted(tuple(r) for r in intervals.union(rows).collect()) == [(1, 0, 7), (1, 9, 10), (2, 1, 2)]


def test_positions_and_boxes(spark):
    gold = spark.createDataFrame([(1, 1, 10.0, 20.0, 5.0, 7.0), (2, 1, 50.0, 60.0, 5.0, 7.0), (3, 1, 90.0, 95.0, 5.0, 7.0)], "id long, page int, x0 double, x1 double, y0 double, y1 double")
    found = spark.createDataFrame([(11, 1, 10.5, 20.5, 6.0, 8.0), (12, 1, 50.0, 60.0, 5.0, 7.0), (13, 1, 51.0, 61.0, 4.0, 6.0), (14, 2, 90.0, 95.0, 5.0, 7.0)], "id long, page int, x0 double, x1 double, y0 double, y1 double")
    assert {tuple(r) for r in intervals.positions_match(gold, found).collect()} == {(1, 1, 11), (2, 2, None), (3, 0, None)}
    tokens = spark.createDataFrame([(1, 1, 1.0, 1.0, 2.0, 2.0, "84.1"), (2, 1, 9.0, 9.0, 11.0, 11.0, "84.1")], "token_id long, page int, x0 double, y0 double, x1 double, y1 double, text string")
    boxes = spark.createDataFrame([(7, 1, 0.0, 0.0, 5.0, 5.0, "is 84.1 %")], "box_id long, page int, bx0 double, by0 double, bx1 double, by1 double, box_text string")
    assert [tuple(r) for r in intervals.boxes_holding(tokens, boxes).collect()] == [(1, 7)]


def test_blocked_regions(spark):
    text = "\\documentclass{a}\n\\begin{document}\nvalue 1 % comment 2\n\\begin{verbatim}3\\end{verbatim} 50\\% \\cite{x4} $$5$$ 6\n"
    d = docs(spark, text, "\\newcommand{\\x}{1} 2", "```\n1\n```\n2 `3` <!-- 4 --> 5")
    kept = {(r.doc_id, r.token) for r in textscan.checkable(d, textscan.number_tokens(d)).collect()}
    assert kept == {(0, "1"), (0, "50"), (0, "6"), (2, "2"), (2, "5")}


def test_anchors_are_unique_or_unknown(spark):
    d = docs(spark, "ab 1 cd ab 2 cd % ab 1 cd", "aaa 5 b", "x\\Ey 9 \\Q")
    exact = spark.createDataFrame([("once", 1, "5"), ("twice", 0, "ab 1 cd"), ("none", 0, "zz"), ("quoted", 2, "\\Ey 9 \\Q")], "anchor_id string, doc_id long, exact string")
    got = {r.anchor_id: (r.hits, r.start, r.error) for r in textscan.unique_or_unknown(exact, textscan.literal_hits(d, exact)).collect()}
    assert got == {"once": (1, 4, None), "twice": (2, None, "ANCHOR_AMBIGUOUS"), "none": (0, None, "ANCHOR_MISSING"), "quoted": (1, 1, None)}
    pairs = spark.createDataFrame([("p", 0, "ab ", " cd"), ("q", 1, "aa", "b"), ("r", 1, "aaa ", " b"), ("s", 0, "zz", "b")], "anchor_id string, doc_id long, prefix string, suffix string")
    hits = textscan.between_hits(d, pairs)
    assert sorted((r.anchor_id, r.start, r.end) for r in hits.collect()) == [("p", 3, 4), ("p", 11, 12), ("p", 21, 22), ("q", 2, 6), ("q", 3, 6), ("r", 4, 5)]


def test_anchor_synthesis_and_blocks(spark):
    d = docs(spark, "acc is 5 here. loss is 5 there.", "5 5")
    targets = spark.createDataFrame([("a", 0, 7, 8), ("b", 0, 23, 24), ("c", 1, 0, 1)], "target_id string, doc_id long, start int, end int")
    got = {r.target_id: r for r in textscan.synthesise_anchors(d, targets).collect()}
    for name, start in (("a", 7), ("b", 23)):
        text = "acc is 5 here. loss is 5 there."
        p, s = got[name].prefix, got[name].suffix
        assert got[name].error is None and text[start - len(p) : start] == p and text[start + 1 : start + 1 + len(s)] == s
    assert got["c"].error == "NO_UNIQUE_ANCHOR"
    e = docs(spark, "The mean is 5.\n\nOther 6 text", "The mean is 7.")
    blocks = {(r.doc_id, r.block): r for r in textscan.blocks(e).collect()}
    assert blocks[0, 0].identity == blocks[1, 0].identity != blocks[0, 1].identity
    anchor = spark.createDataFrame([("x", 0, blocks[0, 1].identity, "6"), ("y", 0, blocks[0, 1].identity, "e")], "anchor_id string, doc_id long, identity string, exact string")
    found = {r.anchor_id: (r.start, r.error) for r in textscan.locate_in_block(e, anchor).collect()}
    assert found == {"x": (22, None), "y": (None, "ANCHOR_AMBIGUOUS")}


def test_patches(spark):
    d = docs(spark, "a 1 b 2", "x 1", "y 1", "z")
    c = spark.createDataFrame([(0, 2, 3, "1", "10"), (0, 6, 7, "2", "é"), (1, 2, 3, "9", "1"), (2, 0, 2, "y ", ""), (2, 1, 3, " 1", "")], "doc_id long, start int, end int, before string, after string")
    got = {r.doc_id: (r.text, r.error, r.changed) for r in textscan.apply_patches(d, c).collect()}
    assert got == {0: ("a 10 b é", None, True), 1: ("x 1", "PATCH_STALE", False), 2: ("y 1", "PATCH_OVERLAP", False), 3: ("z", None, False)}


def test_lines_sections_figures(spark):
    d = docs(spark, "ab\ncé 1", "![x](img/a.png) \\includegraphics[w=1]{b}")
    places = spark.createDataFrame([(0, 5), (0, 0)], "doc_id long, start int")
    assert sorted((r.line, r.column, r.byte_start) for r in textscan.line_and_column(d, places).collect()) == [(1, 1, 0), (2, 3, 6)]
    refs = textscan.figure_references(d).select(F.lit("p/m.tex").alias("file"), "target")
    files = spark.createDataFrame([("p/b.pdf",), ("b.png",), ("img/a.png",)], "path string")
    assert {(r.target, r.path, r.error) for r in textscan.resolve_figures(refs, files).collect()} == {("img/a.png", "img/a.png", None), ("b", None, "FIGURE_AMBIGUOUS")}
    lines = spark.createDataFrame([(0, i, t) for i, t in enumerate(["# A", "x", "## B", "### C", "## D", "# E", "y"])], "doc_id long, line int, text string")
    assert [r.path for r in textscan.section_paths(lines).orderBy("line").collect()] == ["A", "A", "A / B", "A / B / C", "A / D", "E", "E"]


PIPES = "Table 1: x\n\n| model | acc | f1 |\n|---|:-:|--:|\n| a | 0.8 | 0.8 |\n| b | 0.8 | 0.7 % |\n\ntext | with bar\n\n| p | q |\n|---|---|\n| 1 |\n"


def test_pipe_tables(spark):
    cells = tables.pipe_cells(docs(spark, PIPES, "nothing"))
    rows = sorted((r.table_id, r.row, r.col, r.cell) for r in cells.collect())
    assert rows == [(0, i, j, c) for i, r in enumerate((("model", "acc", "f1"), ("a", "0.8", "0.8"), ("b", "0.8", "0.7 %"))) for j, c in enumerate(r)]
    assert {r.caption for r in cells.collect()} == {"Table 1: x"}
    anchors = spark.createDataFrame([("ok", 0, ["model", "acc", "f1"], ["b"], 2), ("gone", 0, ["model", "acc", "f1"], ["c"], 1), ("text", 0, ["model", "acc", "f1"], ["a"], 0)], "anchor_id string, doc_id long, headers array<string>, row_prefix array<string>, column int")
    got = {r.anchor_id: (r.row, r.cell, r.error) for r in tables.locate_cells(cells, anchors).collect()}
    assert got == {"ok": (2, "0.7 %", None), "gone": (None, None, "ANCHOR_MISSING"), "text": (None, None, "NUMERIC_ANCHOR")}
    assert sorted((r.row, r.prefix) for r in tables.row_prefixes(cells).collect()) == [(1, ["a"]), (2, ["b"])]
    context = {(r.row, r.col): (r.row_text, r.column_header) for r in tables.location_context(cells).collect()}
    assert context[1, 1] == ("a | [value] | 0.8", "acc")
    shapes = {(r.row, r.col): (r.shape, r.left, r.right) for r in tables.number_contexts(cells).collect()}
    assert shapes[2, 2] == ("<number> %", "", " %")


def test_latex_tables(spark):
    text = "\\begin{tabular}{lr}\\toprule\nmodel & acc \\\\ \\midrule\n% note\nOurs & 84.1\\% \\\\ A\\&B & 80.7 \\\\\n\\bottomrule\\end{tabular} \\begin{tabular}{l}\\multicolumn{2}{c}{x} & 1\\end{tabular} \\begin{tabular}{l}{a & b} \\\\ c & 2\\end{tabular}"
    rows = sorted((r.table_id, r.row, r.col, r.cell) for r in tables.latex_cells(docs(spark, text)).collect())
    assert rows == [(0, 0, 0, "model"), (0, 0, 1, "acc"), (0, 1, 0, "Ours"), (0, 1, 1, "84.1\\%"), (0, 2, 0, "A\\&B"), (0, 2, 1, "80.7")]


def test_suggestions_go_by_identity_only(spark):
    choices = spark.createDataFrame([("c1", {"model": "001", "split": "test"}, "accuracy"), ("c2", {"model": "1", "split": "test"}, "accuracy"), ("c3", {"model": "Straße", "split": "x"}, "f1")], "choice string, identity map<string,string>, field string")
    places = spark.createDataFrame([("l1", "model 001 | test | [value]", "Accuracy", True), ("l2", "1 | train | [value]", "loss", True), ("l3", "STRASSE | [value]", None, False), ("l4", "0.001 test", "accuracy", False)], "location string, row_text string, column_header string, is_table boolean")
    aliases = spark.createDataFrame([("split", "training", "train"), ("split", "Dup", "a"), ("split", "dup ", "b")], "column string, label string, value string")
    assert [r.label for r in suggest.alias_conflicts(aliases).collect()] == ["dup"]
    got = suggest.suggest(choices, places, aliases).collect()
    best = {r.choice: (r.location, r.matched, r.missing) for r in got if r.rank == 1}
    assert best == {"c1": ("l1", ["model", "split"], []), "c2": ("l1", ["split"], ["model"]), "c3": ("l3", ["model"], ["split"])}
    assert ("c2", "l2") in {(r.choice, r.location) for r in got} and not any(r.location == "l4" and "model" in r.matched for r in got)


def test_closures(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "src string, dst string")
    got = {(r.root, r.node): r.depth for r in graphs.closure(edges).collect()}
    assert got["a", "d"] == 3 and got["a", "a"] == 0 and got["x", "y"] == 1 and ("d", "a") not in got and len(got) == 14
    assert {r.node for r in graphs.cycles(edges).collect()} == {"x", "y"}
    assert {(r.root, r.leaf) for r in graphs.leaves(edges).collect()} == {(r, "d") for r in "abcd"}
    files = spark.createDataFrame([("m.tex", "\\input{a} \\include{s/b} \\input{gone}"), ("a.tex", ""), ("s/b.tex", "\\input{a}"), ("s/a.tex", "")], "file string, text string")
    found = {(r.src, r.target): (r.dst, r.error) for r in graphs.resolve_includes(files).collect()}
    assert found == {("m.tex", "a"): ("a.tex", None), ("m.tex", "s/b"): ("s/b.tex", None), ("m.tex", "gone"): (None, "MISSING_INCLUDE"), ("s/b.tex", "a"): (None, "AMBIGUOUS_INCLUDE")}


def test_coverage_with_exclusions(spark):
    d = docs(spark, "bound 1, excluded 2, changed 3, free 4")
    spans = {str(i): (m.start(), m.end()) for i, m in enumerate(NUMBER.finditer("bound 1, excluded 2, changed 3, free 4"), 1)}
    bound = spark.createDataFrame([(0, *spans["1"])], "doc_id long, start int, end int")
    raw = spark.createDataFrame([(1, 0, *spans["2"]), (2, 0, *spans["3"]), (3, 0, *spans["1"]), (4, 0, *spans["2"])], "ord long, doc_id long, start int, end int")
    marked = ck.context_hash(d, raw).withColumn("context_hash", F.when(F.col("ord") == 2, "old").otherwise(F.col("context"))).drop("context")
    errors = {r.ord: r.error for r in ck.active_exclusions(d, bound, marked).collect()}
    assert errors == {1: None, 2: "EXCLUSION_CHANGED", 3: "EXCLUSION_BOUND", 4: "EXCLUSION_OVERLAP"}
    assert {r.token: r.state for r in ck.coverage(d, bound, marked).collect()} == {"1": "bound", "2": "excluded", "3": "unbound", "4": "unbound"}


def test_sums_before(spark):
    rng = random.Random(6)
    rows = [[], [5], *[[rng.randint(0, 9) for _ in range(n)] for n in (2, 511, 512, 513, 1024, 1600)]]
    df = spark.createDataFrame([(r,) for r in rows], "v array<int>")
    for given, got in ((r.v, r.b) for r in df.select("v", textscan._sums_before(F.col("v")).alias("b")).collect()):
        assert got == [sum(given[:k]) for k in range(len(given))]


def test_long_texts_are_linear(spark):
    n = 60_000
    text = " ".join(f"{k % 1000} ab" for k in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.perf_counter()
    out = textscan.number_tokens(docs, context=0).agg(F.count("ord").alias("n"), F.max("end").alias("last")).first()
    assert (out.n, out.last) == (n, len(text) - 3)
    hits = textscan.literal_hits(docs, docs.select(F.lit("a").alias("anchor_id"), "doc_id", F.lit("ab").alias("exact")))
    assert tuple(hits.agg(F.count("start"), F.max("end")).first()) == (n, len(text))
    assert time.perf_counter() - start < 60


def test_closure_of_a_long_chain_and_a_cycle(spark):
    n = 5_000
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    roots = spark.createDataFrame([(0,), (n - 3,)], "root long")
    got = {(r.root, r.node): r.depth for r in graphs.closure(edges, roots).collect()}
    assert got == {(0, k): k for k in range(n + 1)} | {(n - 3, n - 3 + k): k for k in range(4)}
    ring = spark.range(37).select(F.col("id").alias("src"), ((F.col("id") + 1) % 37).alias("dst"))
    assert {(r.root, r.node): r.depth for r in graphs.closure(ring).collect()} == {(a, b): (b - a) % 37 for a in range(37) for b in range(37)}


def test_literals_anywhere(spark):
    texts = ["aaaa ba", "", None, "ab ab", "x.*y x.*y é", "aa"]
    literals = ["aa", "a", "ab", "x.*y", "é", "", "none", "aa"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = spark.createDataFrame([(f"k{i}", x) for i, x in enumerate(literals)], "anchor_id string, exact string")
    want = set()
    for i, x in enumerate(literals):
        for d, text in enumerate(texts):
            at = (text or "").find(x) if x else -1
            while at >= 0:
                want.add((f"k{i}", d, at, at + len(x)))
                at = text.find(x, at + len(x))
    for chars in (1_000_000, 4):
        assert {tuple(r) for r in textscan.literals_anywhere(df, wanted, chars).collect()} == want
    assert textscan.literals_anywhere(df, wanted.where("exact = ''")).collect() == []


def test_anchors_against_all_contexts(spark):
    """Every context pair tried by plain search, on texts with few different contexts."""
    rng = random.Random(12)
    texts = ["".join(rng.choice(["a ", "b ", "ab", ", ", "1 ", "22 ", "é "]) for _ in range(60)) for _ in range(8)]
    token = re.compile(textscan.NATIVE_TOKEN, re.ASCII)
    rows = [(f"{d}/{m.start()}", d, *m.span()) for d, text in enumerate(texts) for m in token.finditer(text)]
    got = {r.target_id: (r.prefix, r.suffix) for r in textscan.synthesise_anchors(docs(spark, *texts), spark.createDataFrame(rows, "target_id string, doc_id long, start int, end int")).collect()}
    assert len(got) == len(rows)
    for name, d, start, end in rows:
        text, spans = texts[d], [m.span() for m in token.finditer(texts[d])]
        i = spans.index((start, end))
        low, high = spans[i - 1][1] if i else 0, spans[i + 1][0] if i + 1 < len(spans) else len(text)
        want = (None, None)
        for before, after in textscan._CONTEXTS:
            prefix, suffix = text[max(low, start - before) : start], text[end : min(high, end + after)]
            if prefix and suffix:
                ends = [k + len(prefix) for k in range(len(text)) if text.startswith(prefix, k)]
                hits = [(e, text.find(suffix, e)) for e in ends if text.find(suffix, e) >= e]
                if hits == [(start, end)]:
                    want = prefix, suffix
                    break
        assert got[name] == want, (text, start)


def test_many_changes_of_one_text_and_many_targets(spark):
    words = [f"w{i} {i}" for i in range(100_000)]
    text = " ".join(words)
    at, changes = 0, []
    for w in words:
        changes.append((0, at, at + len(w), w, w.upper()))
        at += len(w) + 1
    d = docs(spark, text)
    started = time.time()
    got = textscan.apply_patches(d, spark.createDataFrame(changes, "doc_id long, start int, end int, before string, after string")).first()
    assert got.changed and got.text == text.upper() and time.time() - started < 60
    targets = [(k, 0, m.start(), m.end()) for k, m in enumerate(re.compile(textscan.NATIVE_TOKEN, re.ASCII).finditer(text[:200_000]))]
    anchored = textscan.synthesise_anchors(docs(spark, text[:200_000]), spark.createDataFrame(targets, "target_id int, doc_id long, start int, end int"))
    assert anchored.where("error is null").count() > 0.9 * len(targets) and time.time() - started < 180


def test_tables_that_grow_together_are_not_broadcast(spark, capsys):
    n = spark.range(50)
    refs = n.select(F.format_string("p/%s.tex", "id").alias("file"), F.format_string("f%s", "id").alias("target"))
    textscan.resolve_figures(refs, n.select(F.format_string("f%s.pdf", "id").alias("path"))).explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_blocks_are_found_without_a_broadcast(spark, capsys):
    d = spark.range(50).select(F.col("id").alias("doc_id"), F.format_string("Total %s.\n\nNone.", "id").alias("text"))
    anchors = textscan.blocks(d).where("block = 0").select("doc_id", "identity", F.col("doc_id").alias("anchor_id"), F.col("doc_id").cast("string").alias("exact"))
    found = textscan.locate_in_block(d, anchors)
    found.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert {(r.hits, r.start, r.error) for r in found.collect()} == {(1, 6, None)}


def test_short_texts_need_no_lists_of_hashes(monkeypatch):
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice("ab 1") for _ in range(rng.randint(3, 40)))
        start, end = sorted(rng.sample(range(1, len(text)), 2))
        for before, after in ((1, 1), (2, 1), (1, 3)):
            if before <= start and end + after <= len(text):
                assert textscan._alone_near(text, start, end, before, after) == textscan._Places(text).alone(start, end, before, after, 1000)
    targets = [[{"target_id": 1, "start": 6, "end": 7}], [{"target_id": 2, "start": 5, "end": 6}, {"target_id": 3, "start": 0, "end": 2}]]
    batch = pa.RecordBatch.from_pydict({"text": ["cost [5]", "[1] [5]."], "targets": targets})
    monkeypatch.setattr(textscan, "_Places", None)
    ids, prefixes, suffixes = next(textscan._anchored([batch]))
    assert (ids.to_pylist(), prefixes, suffixes) == ([1, 2, 3], ["[", " [", None], ["]", "]", None])


def test_numbers_are_cut_out_once(spark, capsys):
    texts = ["1 \x01 2", "\x013", " ".join(map(str, range(9))), "a 1 % 2\n3 `4` 5", "\\def\\x{1} 2"]
    d = docs(spark, *texts)
    tokens = textscan.number_tokens(d)
    assert sorted((r.doc_id, r.start, r.end, r.token) for r in tokens.collect()) == sorted((i, m.start(), m.end(), m.group()) for i, t in enumerate(texts) for m in NUMBER.finditer(t))
    none = spark.createDataFrame([], "ord long, doc_id long, start int, end int, context_hash string")
    out = ck.coverage(d, none.select("doc_id", "start", "end"), none)
    out.explain()
    assert "regexp" not in capsys.readouterr().out.lower()
    assert {(r.doc_id, r.token) for r in out.where("doc_id > 2").collect()} == {(3, "1"), (3, "3"), (3, "5")}


def test_sole_places_equal_joined_ones(spark):
    texts = ["", None, "a5b", "ab", "a5b a6b", "a5 a6b", "a a a7b", "aa7b", "a7", "aaa", "x a" + "7" * 1001 + "b a8b", "a" + "7" * 1001 + "b", "a\U0001f6000b.", "a1b a2 a3", "b a1b"]
    contexts = [("a", "b"), ("aa", "b"), ("a", "bb"), ("", "b"), (".", "b"), ("a ", "b"), ("\U0001f600", "b")]
    rows = spark.createDataFrame([(f"{i}/{j}", t, p, s) for i, t in enumerate(texts) for j, (p, s) in enumerate(contexts)], "anchor_id string, text string, prefix string, suffix string")
    documents, anchors = rows.select(F.col("anchor_id").alias("doc_id"), "text"), rows.select("anchor_id", F.col("anchor_id").alias("doc_id"), "prefix", "suffix")
    want = textscan.unique_or_unknown(anchors, textscan.between_hits(documents, anchors))
    columns = ["anchor_id", "start", "end", "error"]
    got = textscan.sole_places(rows)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert {r.error for r in got.collect()} == {None, "ANCHOR_MISSING", "ANCHOR_AMBIGUOUS"}
