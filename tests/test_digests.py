"""The digest of a multiset against one built by hand, for trees of several depths at once."""

import hashlib
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from concordat.operators import digests, scratch


def by_hand(marks, children):
    """The same tree, from the leaves up."""
    counted = Counter(marks)
    depth = max(0, math.ceil(math.log2(len(counted) / children) / 4)) if counted else 0
    nodes = {h: str(n) for h, n in counted.items()}
    for level in [k for k in range(depth, -1, -1) if k == depth or k % digests.DIGITS == 0]:
        groups = {}
        for h, node in nodes.items():
            groups.setdefault(h[:level], []).append(f"{h}:{node}")
        nodes = {p: hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for p, x in groups.items()}
    return nodes[""]


def test_trees_of_different_depths(spark, monkeypatch):
    monkeypatch.setattr(digests, "CHILDREN", 2)
    rng = random.Random(3)
    rows = [("a", str(rng.randrange(3000))) for _ in range(2500)] + [("b", "x")] * 50 + [("c", str(k)) for k in range(20)]
    df = spark.createDataFrame(rows, "g string, v string").withColumn("m", F.sha2("v", 256))
    got = {r.g: (r.n, r.digest) for r in digests.merkle(df, ["g"], "m").collect()}
    for g in "abc":
        marks = [hashlib.sha256(v.encode()).hexdigest() for k, v in rows if k == g]
        assert got[g] == (len(marks), by_hand(marks, 2))
    # Order and partitioning don't matter, one row more or less does.
    again = {r.g: r.digest for r in digests.merkle(df.repartition(7, "v"), ["g"], "m").collect()}
    less = {r.g: r.digest for r in digests.merkle(df.where("not (g = 'c' and v = '3')"), ["g"], "m").collect()}
    assert again == {g: d for g, (_, d) in got.items()} and less["c"] != again["c"] and less["a"] == again["a"]


def test_deep_trees_and_groups_of_copies(spark, monkeypatch):
    """More levels than one step of digits, and groups whose different rows ask for another depth than all of their rows."""
    monkeypatch.setattr(digests, "CHILDREN", 0.02)
    rows = [("deep", str(k)) for k in range(1400)] + [("copies", str(k % 3)) for k in range(900)] + [("one", "x")]
    df = spark.createDataFrame(rows, "g string, v string").withColumn("m", F.sha2("v", 256))
    want = {g: [hashlib.sha256(v.encode()).hexdigest() for k, v in rows if k == g] for g in ("deep", "copies", "one")}
    sizes = df.groupBy("g").agg(F.count("*").alias("n"))
    for known in (None, sizes):
        got = {r.g: (r.n, r.digest) for r in digests.merkle(df, ["g"], "m", known).collect()}
        assert got == {g: (len(m), by_hand(m, 0.02)) for g, m in want.items()}


def test_leaves_are_not_saved(spark, monkeypatch):
    """What a digest leaves on disk is its nodes, far fewer rows than it digests."""
    saved = []

    class Seen(scratch.Scratch):
        def save(self, df, name):
            out = super().save(df, name)
            saved.append(out.count())
            return out

    monkeypatch.setattr(digests, "Scratch", Seen)
    df = spark.range(50_000).select(F.lit("g").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("m"))
    assert digests.merkle(df, ["g"], "m").count() == 1 and 0 < max(saved) < 1000
