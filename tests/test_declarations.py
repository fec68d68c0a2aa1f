"""Functions and plans on declarations: exact JSON, labels, reconciliation, containers, staging, drafts, local relations."""

import json
from decimal import Decimal

from pyspark.sql import functions as F

from concordat.functions import lexeme as lx
from concordat.operators import metrics as mx
from concordat.operators import scoring
from concordat.operators.declared import declared
from concordat.plans import review


def test_exact_json(spark):
    rows = [("a\"b\\c\n€", "1.500", 7), (None, "-0.0", None), ("", "1e3", 0), ("x", "12345678901234567890.123456789012345678", 1), ("y", None, 2)]
    df = spark.createDataFrame(rows, "s string, d string, i int")
    out = [r.j for r in df.select(lx.exact_json({"z": (F.col("s"), "string"), "a": (F.col("d"), "decimal"), "m": (F.col("i"), "integer")}).alias("j")).collect()]
    assert [list(json.loads(x)) for x in out] == [["a", "m", "z"]] * 5
    for text, (s, d, i) in zip(out, rows, strict=True):
        got = json.loads(text, parse_float=Decimal, parse_int=Decimal)
        assert got["z"] == s and got["m"] == i and got["a"] == (None if d is None else Decimal(d))
    assert out[1] == '{"a":0,"m":null,"z":null}' and out[2].startswith('{"a":1000,')


def test_location_label(spark):
    df = spark.createDataFrame([("a.tex", "latex", "3", None), ("a.pdf", "pdf", "3", None), ("a.md", "markdown", None, "1")], "file string, fmt string, line string, tab string")
    out = [r.x for r in df.select(lx.location_label("file", "fmt", "line", "tab", F.lit("2"), F.lit("0")).alias("x")).collect()]
    assert out == ["a.tex:3", "a.pdf", "a.md, table 1, row 2, column 0"]


def test_reconciliation(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",), ("z",), (None,)], "k string")
    b = spark.createDataFrame([("x",), ("y",), ("w",)], "k string")
    out = {r.k: (r.records, r.locations, r.error) for r in mx.reconciled(a, b, ["k"]).collect()}
    assert out == {"x": (1, 1, None), "y": (2, 1, "RECORD_COUNT"), "z": (1, 0, "LOCATION_MISSING"), "w": (0, 1, "RECORD_MISSING"), None: (1, 0, "LOCATION_MISSING")}
    assert mx.reconciled(a.limit(0), b.limit(0), ["k"]).count() == 0


def test_containers(spark):
    gold = spark.createDataFrame([(1, 0, 1.0, 1.0, 2.0, 2.0, "5.1"), (2, 0, 1.0, 1.0, 2.0, 2.0, "7"), (3, 1, 1.0, 1.0, 2.0, 2.0, "5.1"), (4, 0, 8.0, 8.0, 9.0, 9.0, "5.1")], "token_id int, page int, x0 double, y0 double, x1 double, y1 double, text string")
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0, 5.0, "is 5.1 or 7 now"), (2, 0, 1.0, 1.0, 2.0, 2.0, "7"), (3, 1, 1.5, 0.0, 5.0, 5.0, "5.1")], "box_id int, page int, bx0 double, by0 double, bx1 double, by1 double, box_text string")
    assert {r.target: (r.boxes, r.outcome) for r in scoring.containers(gold, boxes).collect()} == {1: (1, "supported"), 2: (2, "ambiguous"), 3: (0, "missed"), 4: (0, "missed")}


def test_rebuilt_draft(spark):
    edges = spark.createDataFrame([("b", "m"), ("m", "s"), ("c", "n"), ("d", "q")], "src string, dst string")
    chosen = spark.createDataFrame([("b",), ("c",), ("d",), ("e",)], "name string")
    before = spark.createDataFrame([("s", "1"), ("n", "1"), ("q", "1")], "name string, fingerprint string")
    after = spark.createDataFrame([("s", "2"), ("q", "1"), ("t", "1")], "name string, fingerprint string")
    out = {r.name: (r.state, r.changed) for r in review.rebuilt_draft(chosen, edges, before, after).collect()}
    assert out == {"b": ("check_again", ["s"]), "c": ("lost", ["n"]), "d": ("kept", []), "e": ("kept", [])}


def test_declared_rows_are_a_local_relation(spark):
    df = declared(spark, [("a", 1, ["x", None], {"k": "v"}), (None, None, None, None)], "s string, n long, a array<string>, m map<string,string>")
    assert "LocalRelation" in df._jdf.queryExecution().analyzed().toString() or "LocalRelation" in df._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in df.collect()] == [("a", 1, ["x", None], {"k": "v"}), (None, None, None, None)]
    assert declared(spark, [], "s string").count() == 0


def test_evidence_of_derived_metrics_is_united(spark):
    own = spark.createDataFrame([("a", "1", "scalar", None, "f1"), ("b", "2", "scalar", None, "f2"), ("c", "4", "scalar", None, "f1")], "metric string, value string, unit string, error string, fingerprint string")
    wanted = [mx.Derived("x", "difference", "a", "b"), mx.Derived("y", "ratio", "x", "c"), mx.Derived("z", "difference", "y", "gone")]
    out = {r.metric: r for r in mx.derive(own, wanted).collect()}
    assert sorted(out["x"].evidence) == ["f1", "f2"] and sorted(out["y"].evidence) == ["f1", "f2"]
    assert Decimal(out["y"].value) == Decimal("-0.25") and out["z"].error == "UNKNOWN_METRIC" and sorted(out["z"].evidence) == ["f1", "f2"]
