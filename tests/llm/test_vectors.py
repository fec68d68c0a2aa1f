"""Operators 11 and 12 against brute force, their SQL and odd tables."""

import hashlib
import random

import numpy as np
import pytest

from concordat.llm import codebooks, maxscore
from concordat.llm.queries import ORACLE_SQL, QUERIES

from .helpers import SF

SCHEMA = "vec_id long, embedding array<double>, label int, score string, row int"
INF, NAN = float("inf"), float("nan")


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA)


def odd_rows(rng, n=300, width=6):
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.3, 1.0, 2.0]) for _ in range(width)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(900, None, 1), (920, [None] * width, 1), (940, [NAN] + [0.0] * (width - 1), 1), (960, [INF] + [1.0] * (width - 1), 2), (980, [1.0, 2.0], 2), (None, [2.0] * width, None), (1000, [], 1)]
    return rows + rows[:25] + [(1020, rows[3][1], 2)] * 3


def wholes(vector, scale):
    if vector is None or any(x is None or x != x or abs(x) == INF for x in vector):
        return None
    return [int(np.floor(x * scale)) if abs(x) < 1e15 else int(x) * scale for x in vector]


def brute_top_k(rows, k):
    held = [(i, w) for i, v, _ in rows if (w := wholes(v, 64)) is not None]
    out = []
    for a, (qid, q) in enumerate(held):
        if qid is None or qid % 20:
            continue
        scored = [(-sum(x * y for x, y in zip(q, w)), i is None, i or 0, i) for b, (i, w) in enumerate(held) if b != a]
        out += [(qid, rank, i, -s if abs(s) < 2**63 else None) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard, block, k", [(32768, 4096, 20), (40, 5, 7), (1, 1, 3)])
def test_top_k_against_brute_force(spark, shard, block, k):
    rows = odd_rows(random.Random(5), n=300 if shard > 1 else 60)
    got = maxscore.top_k(table(spark, rows), k=k, shard=shard, block=block).collect()
    assert sorted(map(tuple, got), key=repr) == brute_top_k(rows, k)


def test_search_keeps_every_winner_and_probes(monkeypatch):
    rng = np.random.default_rng(3)
    shard = rng.integers(-30, 30, (3000, 24))
    shard[100:140] = shard[7]
    queries = np.concatenate([shard[:40] + rng.integers(-2, 3, (40, 24)), rng.integers(-30, 30, (20, 24)), np.zeros((1, 24), np.int64)])
    own = np.where(np.arange(61) < 40, np.arange(61), -1)
    for share in ((0, 1), (3, 10), (1, 1)):
        monkeypatch.setattr(maxscore, "NON_ESSENTIAL", share)
        query, score, place = maxscore.search(queries, shard, own, 9)
        for i in range(len(queries)):
            scores = queries[i] @ shard.T
            order = [j for j in np.lexsort((np.arange(len(shard)), -scores)) if j != own[i]][:9]
            assert place[query == i].tolist() == order and score[query == i].tolist() == scores[order].tolist()


def test_scores_beyond_doubles_and_longs(spark):
    rows = [(20, [1e9, 3.0], 1), (1, [1e9, 1.0], 1), (2, [1e9, 2.0], 1), (3, [-1e9, 2.0], 1), (40, [1e30, 1.0], 1), (4, [1e30, 2.0], 1), (5, [1e200, 0.0], 1)]
    assert sorted(map(tuple, maxscore.top_k(table(spark, rows), k=4).collect()), key=repr) == brute_top_k(rows, 4)


def test_top_k_of_empty_and_tiny_tables(spark):
    assert maxscore.top_k(table(spark, [])).collect() == []
    assert maxscore.top_k(table(spark, [(20, [1.0], 1)])).collect() == []
    assert list(map(tuple, maxscore.top_k(table(spark, [(20, [1.0], 1), (7, [2.0], 1)])).collect())) == [(20, 1, 7, 64 * 128)]


def brute_codes(rows, parts=8, entries=16, rounds=6):
    held = [(i, w, label) for i, v, label in rows if (w := wholes(v, 4096)) is not None]
    if not held:
        return []
    width = -(-max(len(w) for _, w, _ in held) // parts) * parts
    held = [(i, w + [0] * (width - len(w)), label, [x for x in v]) for (i, w, label), v in zip(held, (v for _, v, _ in rows if wholes(v, 1) is not None))]
    size = width // parts
    cut = [[w[p * size : (p + 1) * size] for p in range(parts)] for _, w, _, _ in held]
    first = sorted(range(len(held)), key=lambda r: (held[r][0] is None, held[r][0] or 0, held[r][3]))[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for c in cut:
                mine[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(m) for x in zip(*m)] if m else old for m, old in zip(mine, books[p])]
    sha = hashlib.sha256(",".join(str(v) for b in books for y in b for v in y).encode()).hexdigest()
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    total = {label: sum(e for e, h in zip(errors, held) if h[2] == label) for label in {h[2] for h in held}}
    fits = lambda x: x if abs(x) < 2**63 else None
    out = [(h[0], "".join(f"{e:02x}" for _, e in f), fits(e), fits(total[h[2]]), sha) for h, f, e in zip(held, found, errors)]
    return sorted(out, key=repr)


def test_codes_against_brute_force(spark):
    rows = odd_rows(random.Random(8), width=16)
    assert sorted(map(tuple, codebooks.compress(table(spark, rows)).collect()), key=repr) == brute_codes(rows)


def test_codes_of_few_wide_and_huge_vectors(spark):
    for rows in ([], [(3, [], None)], [(3, [0.5] * 3, None), (1, [-0.5] * 9, 2)], [(i, [float(i % 7) * 1e15, -1e25 * (i % 3), 0.1] * 4, 1) for i in range(40)]):
        assert sorted(map(tuple, codebooks.compress(table(spark, rows), rounds=2).collect()), key=repr) == brute_codes(rows, rounds=2)


@pytest.mark.parametrize("entries", [1, 2, 16, 60])
def test_orchard_finds_the_nearest_with_ties(entries):
    rng = np.random.default_rng(entries)
    book, parts = rng.integers(-4, 5, (entries, 3)), rng.integers(-6, 7, (800, 3))
    if entries > 2:
        book[1] = book[-1] = book[0]
    distance = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    for start in (None, rng.integers(0, entries, 800)):
        code, best = codebooks.nearest(parts, book, start)
        # argmin takes the first of equals
        assert code.tolist() == distance.argmin(axis=1).tolist() and best.tolist() == distance.min(axis=1).tolist()


@pytest.mark.parametrize("name", ["op11_top_k", "op12_vector_codes"])
def test_queries_agree_with_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = QUERIES[name](spark, SF)
    duckdb.sql(f"create or replace view embeddings as select * from '{SF}/embeddings.parquet'")
    want = duckdb.sql(f"select {', '.join(df.columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
