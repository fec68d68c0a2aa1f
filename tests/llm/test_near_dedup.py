import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordat.llm import near_dedup as nd
from concordat.llm.common import shingle_hashes, word_hashes

from . import helpers as h


def rows_of(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_word_hashes_see_words_only():
    a, b = word_hashes("The  cat\nsat\x0b on"), word_hashes("the cat SAT on ")
    assert (a == b).all() and len(a) == 4
    assert len(word_hashes("")) == len(word_hashes(" \t\n")) == 0
    assert len(set(word_hashes("a b ab ba é è  x").tolist())) == 7


def test_short_texts_are_one_shingle():
    assert len(shingle_hashes(word_hashes("one two"), 4)) == 1
    assert shingle_hashes(word_hashes("one two"), 4) != shingle_hashes(word_hashes("two one"), 4)


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(5)
    chunks, length, errors = 6, 4, 1
    most = chunks * (errors + 1) - 1
    a = rng.integers(0, 2**16, (400, chunks * length)).astype(np.uint16)
    b = a.copy()
    for i in range(len(b)):
        places = rng.permutation(chunks * length)[: int(rng.integers(0, most + 1))]
        b[i, places] ^= 1
    x, y = (nd.chunk_keys(s, chunks, length, errors).reshape(len(s), -1) for s in (a, b))
    assert all(set(p) & set(q) for p, q in zip(x.tolist(), y.tolist(), strict=True))


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts, k = {}, 0
    for _ in range(25):
        base = h.words(rng, rng.choice([1, 3, 5, 12, 40, 120]))
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(["zz", "yy", own[0].upper()])
            texts[k] = rng.choice(["", " "]) + rng.choice([" ", "\n", "  "]).join(own)
            k += 1
    expected = h.components(texts, 4)
    got = rows_of(nd.near_duplicates(h.documents(spark, texts.items()), width=4))
    assert got == {d: (len(h.shingles(t, 4)), expected[d], expected[d] == d) for d, t in texts.items()}


@pytest.mark.parametrize("bucket", [1500, 40, 3])
def test_large_buckets_are_split_without_loss(spark, monkeypatch, bucket):
    # Chains of texts in one bucket, more than a bucket may hold.
    rng = random.Random(8)
    monkeypatch.setattr(nd, "BUCKET", bucket)
    shared, texts = h.words(rng, 60), {}
    for d in range(60):
        own = shared + h.words(rng, 12) if d % 3 else shared[:48] + h.words(rng, 30)
        texts[d] = " ".join(own)
    for d in range(60, 90):
        texts[d] = texts[d - 60] + " tail"
    expected = h.components(texts, 4)
    got = rows_of(nd.near_duplicates(h.documents(spark, texts.items()), width=4))
    assert {d: c for d, (_, c, _) in got.items()} == expected


def test_second_keys_keep_the_distance_of_a_crowded_bucket():
    import pyarrow as pa

    rng = np.random.default_rng(11)
    chunks, length, errors = 6, 4, 1
    most, choices = chunks * (errors + 1) - 1, 4
    split = nd._second_keys(chunks, length, errors)
    for _ in range(300):
        a = rng.integers(0, 2**16, chunks * length).astype(np.uint16)
        b = a.copy()
        b[rng.permutation(chunks * length)[: int(rng.integers(0, most + 1))]] ^= 1
        keys = nd.chunk_keys(np.stack([a, b]), chunks, length, errors)
        shared = np.argwhere(keys[0] == keys[1])
        assert len(shared)
        for chunk, choice in shared[:2]:
            rows = pa.RecordBatch.from_pydict({"key": keys[:, chunk, choice].view(np.int64), "id": [1, 2], "comp": [1, 2], "size": pa.array([9, 9], pa.int32()), "slot": pa.array([chunk * choices + choice] * 2, pa.int16()), "signature": [a.tobytes(), b.tobytes()]})
            out = pa.Table.from_batches(list(split([rows]))).to_pydict()
            held = {i: {k for k, j in zip(out["key"], out["id"], strict=True) if j == i} for i in (1, 2)}
            assert held[1] & held[2]


def test_crowded_buckets_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "BUCKET", 4)  # every bucket of some size is crowded
    rng = random.Random(19)
    base, texts = h.words(rng, 60), {}
    for d in range(70):
        own = list(base)
        for _ in range(rng.choice([3, 4, 5, 6, 9])):
            own[rng.randrange(len(own))] = f"w{rng.randrange(40)}"
        texts[d] = " ".join(own)
    got = rows_of(nd.near_duplicates(h.documents(spark, texts.items()), width=4))
    assert {d: c for d, (_, c, _) in got.items()} == h.components(texts, 4)


def test_a_repeated_doc_id_ties_its_texts(spark):
    a, b, c = (" ".join(h.words(random.Random(k), 30)) for k in (1, 2, 3))
    rows = [(3, a), (5, a), (5, b), (8, c), (9, b), (11, c), (11, a + " z"), (12, "alone")]
    df = h.documents(spark, rows).withColumn("kept_id", F.lit(1)).withColumn("n", F.lit("own")).withColumn("one", F.lit(2)).withColumn("_row", F.lit(3))
    got = sorted((r.doc_id, r.component_id, r.kept) for r in nd.near_duplicates(df).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (8, 3, False), (9, 3, False), (11, 3, False), (11, 3, False), (12, 12, True)]
    kept = nd.deduplicate(df.unionByName(df.where("doc_id = 12")))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 12] and {r.n for r in kept.collect()} == {"own"}


def test_odd_rows(spark):
    long = " ".join(h.words(random.Random(1), 30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, long), (7, long + " x"), (7, long + " x"), (None, "one"), (None, None)]
    df = h.documents(spark, rows).withColumn("n_shingles", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("key", F.lit(2))
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df).collect()), key=str)
    n = len(h.shingles(long, 5))
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, n, 6, True), (7, n + 1, 6, False), (7, n + 1, 6, False), (0, 1, None, True), (0, 0, None, True)], key=str)
    kept = nd.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "None", "None"]


def test_empty_table(spark):
    df = h.documents(spark, [])
    assert nd.near_duplicates(df).count() == 0 and nd.deduplicate(df).count() == 0
