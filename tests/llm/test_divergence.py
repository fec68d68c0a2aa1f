"""Operator 13 against brute force, Spark ML's count vectoriser, its SQL and odd tables."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from concordat.llm import divergence as dv
from concordat.llm.queries import ORACLE_SQL, QUERIES

from .helpers import SF, lower

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n int, term string, item string"


def table(spark, rows):
    return spark.createDataFrame([(k % 7, *r, 1, "t", "i") for k, r in enumerate(rows)], SCHEMA)


def some_rows(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "The", "of", "élan", "ÉLAN", "naïve", "日本", "zu", "x1y", "don't", "rare", "a_b", "ß"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40]))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "é", "z", None])) for _ in range(n)]
    rows += [(None, "fr", "s1"), ("", "fr", "s2"), ("12 34", "it", None), ("lonely words", "nl", "only"), ("word " * 30_000, "en", "s1")]
    return rows + [("alike", "pt", s) for s in "abc" for _ in range(5)]


def brute(rows, least, listed):
    docs = [(lang or "", source or "", TERM.findall(lower(text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        frequency = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in frequency.items() if n >= least}
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        shares, q = {s: share(c) for s, c in counts.items()}, share(whole)
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s, p in shares.items():
            pairs = [(-sum(apart(p[t], other[t]) for t in kept), o.encode()) for o, other in shares.items() if o != s]
            special = [(-apart(p[t], q[t]), t.encode()) for t in kept if counts[s][t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(special)[:listed])):
                out += [(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block, slice_, held", [(256, 4096, 1_000_000), (2, 3, 10), (1, 100, 1)])
def test_divergence_against_brute_force(spark, monkeypatch, block, slice_, held):
    for name, value in (("BLOCK", block), ("SLICE", slice_), ("HELD", held)):
        monkeypatch.setattr(dv, name, value)
    rows = some_rows(11)
    assert sorted(map(tuple, dv.divergence(table(spark, rows), least=10, listed=4).collect())) == brute(rows, 10, 4)


def test_empty_tables_and_languages_without_vocabulary(spark):
    assert dv.divergence(table(spark, [])).collect() == []
    rows = [("a b", "en", "x"), (None, "en", "y"), ("c", "de", "x")]
    assert sorted(map(tuple, dv.divergence(table(spark, rows)).collect())) == brute(rows, 10, 10) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_counts_equal_the_count_vectoriser(spark):
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.stat import Summarizer

    docs = table(spark, [r for r in some_rows(4, 150) if r[1] == "en"])
    split = docs.select(F.coalesce("source", F.lit("")).alias("source"), F.udf(lambda t: [x.decode() for x in dv.terms(t or "")], "array<string>")("text").alias("words"))
    model = CountVectorizer(inputCol="words", outputCol="v", minDF=10, vocabSize=2**31 - 1).fit(split)
    sums = model.transform(split).groupBy("source").agg(Summarizer.sum(F.col("v")).alias("s")).collect()
    want = {(r.source, t): int(n) for r in sums for t, n in zip(model.vocabulary, r.s.toArray()) if n}
    narrow = docs.select("lang", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    counted = narrow.mapInArrow(dv._sums, "lang string, source string, term string, n long, docs long").where("term is not null")
    kept = counted.groupBy("term").agg(F.sum("docs").alias("d")).where("d >= 10")
    got = {(r.source, r.term): r.n for r in counted.groupBy("source", "term").agg(F.sum("n").alias("n")).join(kept, "term").collect()}
    assert got == want


def test_query_agrees_with_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    df = QUERIES["op13_source_divergence"](spark, SF)
    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    want = duckdb.sql(f"select {', '.join(df.columns)} from ({ORACLE_SQL['op13_source_divergence']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
