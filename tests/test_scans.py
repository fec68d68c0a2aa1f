"""Segmented scans and selections by rank against plain Python, with one group that spans all parts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from concordat.operators import intervals, scans, states, textscan


def test_running_values(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.choice([None, *range(9)])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    runs = scans.Runs(df, ["k"], ["i"], parts=7).running(total=("sum", F.col("v")), top=("max", F.col("v")), held=("last", F.col("v"))).running(inclusive=False, before=("sum", F.lit(1)), prior=("last", F.col("total")))
    got = {(r.k, r.i): r for r in runs.result().collect()}
    assert len(got) == len(rows)
    for key in ("hot", "a", None):
        total, top, held, before, prior = None, None, None, None, None
        for _, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            if v is not None:
                total, top, held = (total or 0) + v, max(v, -1 if top is None else top), v
            r = got[key, i]
            assert (r.total, r.top, r.held, r.before, r.prior) == (total, top, held, before, prior)
            before, prior = (before or 0) + 1, prior if total is None else total


def test_numbering_and_empty_tables(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(2).sample(range(10_000), 500)], "x int")
    assert [r.x for r in scans.numbered(df, ["x"]).orderBy("rank").collect()] == sorted(r.x for r in df.collect())
    assert scans.numbered(df.where("x < 0"), ["x"]).collect() == []
    assert list(map(tuple, scans.quantiles(df.where("x < 0"), [], "x", {"p": ("nearest", 0.5)}).collect())) == [(0, None)]


def test_union_of_a_long_document(spark):
    rng = random.Random(3)
    spans = [("d", s, s + rng.randint(0, 9)) for s in rng.choices(range(40_000), k=6000)] + [("e", 5, 9), ("e", 9, 11), ("e", 12, 12)]
    want = []
    for doc in "de":
        for _, s, e in sorted(x for x in spans if x[0] == doc):
            if want and want[-1][0] == doc and s <= want[-1][2]:
                want[-1] = (doc, want[-1][1], max(e, want[-1][2]))
            else:
                want.append((doc, s, e))
    got = intervals.union(spark.createDataFrame(spans, "doc_id string, start int, end int"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # No window gathers a document: every one is by part.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window [max(" not in plan or "_part" in plan


def test_sections_across_parts(spark):
    rng = random.Random(4)
    lines = [("d", i, rng.choice(["# A", "## B ##", "### C", "text", "text", "#no", "###### F"]) + "") for i in range(400)]
    want, held = {}, {}
    for _, i, text in lines:
        level = len(text) - len(text.lstrip("#"))
        if level and text[level : level + 1] == " ":
            held = {k: t for k, t in held.items() if k < level} | {level: text[level:].rstrip("#").strip()}
        want[i] = " / ".join(held[k] for k in sorted(held))
    got = {r.line: r.path for r in textscan.section_paths(spark.createDataFrame(lines, "doc_id string, line int, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("few", [1, 7, 65_536])
@pytest.mark.parametrize("shape", ["even", "few values", "far apart", "one value"])
def test_quantiles(spark, few, shape):
    rng = random.Random(shape)
    draw = {"even": lambda: rng.random(), "few values": lambda: float(rng.randint(0, 3)), "far apart": lambda: math.exp(rng.uniform(-300, 300)) * rng.choice([-1, 1]), "one value": lambda: 2.5}[shape]
    rows = [(rng.choice(["hot"] * 8 + ["b", "c"]), draw()) for _ in range(900)] + [("one", 1.0), ("two", 1.0), ("two", 4.0), ("b", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    points = {"median": ("linear", 0.5), "p95": ("nearest", 0.95), "low": ("nearest", 0.0), "top": ("nearest", 1.0)}
    got = {r.g: r for r in scans.quantiles(df, ["g"], "v", points, few=few).collect()}
    for g in ("hot", "b", "c", "one", "two"):
        values = sorted(v for k, v in rows if k == g and v is not None)
        n, at = len(values), 0.5 * (len(values) - 1)
        a, b = values[math.floor(at)], values[math.ceil(at)]
        r = got[g]
        assert (r.n, r.p95, r.low, r.top) == (n, values[-(-95 * n // 100) - 1], values[0], values[-1])
        assert math.isclose(r.median, a + (b - a) * (at - math.floor(at)), rel_tol=1e-12)
    assert "none" not in got
    whole = scans.quantiles(df, [], "v", {"p95": ("nearest", 0.95)}, few=few).first()
    values = sorted(v for _, v in rows if v is not None)
    assert (whole.n, whole.p95) == (len(values), values[-(-95 * len(values) // 100) - 1])


def test_revision_list_is_one_order(spark):
    rows = [(s, k, f"{k}{i}") for i in range(40) for s, k in (("pass", "claim"), ("unknown", "claim"), ("mismatch", "binding"))]
    got = states.revision_list(spark.createDataFrame(rows, "status string, kind string, subject string")).collect()
    assert [r.rank for r in got] == list(range(1, 121)) and [r.status for r in got] == ["unknown"] * 40 + ["mismatch"] * 40 + ["pass"] * 40


def test_union_scans_a_total_order(spark, monkeypatch):
    """Equal intervals would be ordered by chance, and not alike in both passes."""
    seen = []

    class Seen(scans.Runs):
        def __init__(self, rows, *rest):
            seen.append(rows)
            super().__init__(rows, *rest)

    monkeypatch.setattr(scans, "Runs", Seen)
    spans = spark.createDataFrame([("d", 0, 4), ("d", 9, 12), ("d", 9, 12), ("d", 4, 6)], "doc_id string, start int, end int")
    assert sorted(map(tuple, intervals.union(spans).collect())) == [("d", 0, 6), ("d", 9, 12)]
    assert seen[0].count() == seen[0].distinct().count() == 3
