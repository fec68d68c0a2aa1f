"""The five stages against a brute-force version of each on a small corpus."""

import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline
from concordat.llm.queries import tokenizer_path

from . import helpers as h

LINE = "read more about our offers on the next page"
SECRET = hashlib.sha1(b"pipeline").hexdigest()


def corpus():
    rng = random.Random(31)

    def body(lines=5):
        return "\n".join(" ".join(h.words(rng, 14)) for _ in range(lines))

    item = " ".join(h.words(rng, 40))
    rows = [(d, body()) for d in range(20)]
    rows += [(d, f"{LINE}\n{body()}") for d in range(20, 35)]
    rows += [(40, "too short"), (41, "again " * 40), (42, None)]
    base = body(8)
    rows += [(50, base), (51, base), (52, base.replace(base.split()[3], "changed", 1)), (53, base + " tail")]
    rows += [(60, body(2) + "\n" + item + "\n" + body(2)), (61, item.upper() + "\n" + body())]
    rows += [(70, f'{body(3)} token = "{SECRET}" {body(1)}')]
    return rows, [(1, item), (2, " ".join(h.words(rng, 25)))]


def expected(rows):
    """Ids of the documents that stay, with the texts that reach the tokenizer."""
    out = {}
    for d, text in rows:
        words = h.WORD.findall(text or "")
        if len(words) < 10 or d == 41:
            continue
        out[d] = "\n".join(line for line in text.split("\n") if line != LINE)
    groups = h.components(out, 5)
    out = {d: t for d, t in out.items() if groups[d] == d}
    out = {d: t for d, t in out.items() if d not in (60, 61)}
    return {d: t.replace(SECRET, "[SECRET]") for d, t in out.items()}


def test_stages_against_brute_force(spark, tmp_path):
    import sentencepiece

    rows, items = corpus()
    h.documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = spark.read.parquet(str(tmp_path / "documents.parquet")).columns
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == names, name
            docs.write.parquet(str(tmp_path / f"stage{k}"))
            docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
            if k == 3:
                texts = {r.doc_id: r.text for r in docs.collect()}
                assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    wanted = expected(rows)
    assert texts == wanted
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in docs.collect()}
    assert got == {d: (library.encode(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in wanted.items()}


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    rng = random.Random(5)
    long = "\n".join(" ".join(h.words(rng, 14)) for _ in range(6))
    other = "\n".join(" ".join(h.words(rng, 14)) for _ in range(6))
    rows = [(None, long), (None, None), (1, long), (2, other), (2, other + " more"), (3, ""), (4, f'{other[::-1]} token = "{SECRET}"'), (None, f'token = "{SECRET}" {long[::-1]}')]
    full = h.documents(spark, rows)
    for name in ("key_a", "body", "kept_id", "flags", "one", "_row", "common", "host"):
        full = full.withColumn(name, F.lit(f"own {name}"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for label, docs in (("odd", full), ("empty", full.limit(0))):
        names = docs.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            if k + 1 < len(corpus_pipeline.STAGES):
                assert docs.columns == names, name
                docs.write.parquet(str(tmp_path / f"{label}{k}"))
                docs = spark.read.parquet(str(tmp_path / f"{label}{k}"))
                if k == 3:
                    left = docs.collect()
        if label == "empty":
            assert docs.count() == 0
            continue
        assert all(r[c] == f"own {c}" for r in left for c in names[5:])
        assert not any(SECRET in r.text for r in left)
        assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "4", "None", "None"]
