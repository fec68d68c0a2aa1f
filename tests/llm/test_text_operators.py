import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from concordat.llm import decontaminate as dc
from concordat.llm.common import word_hashes
from concordat.llm.pieces import CharacterMap, PieceModel, encode_and_decode
from concordat.llm.quality_rules import quality_rules
from concordat.llm.queries import tokenizer_path
from concordat.llm.unigram import UnigramCounter, load, token_counts

from . import helpers as h

MODEL = tokenizer_path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a", "a  b ", "Hello world", "naïve café 漢字 😀\x00", "x▁y ▁▁", "\n\t z", "<0x41> </s>", "ﬁﬁ", "it's 1234567 ," * 40, "a" * 3000]


# -- pieces ---------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def random_texts(n=300, alphabet="aethe in▁\nü漢😀𝄞ൠ \x01"):
    rng = random.Random(4)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_ids_decoding_and_spans_are_the_library_s(library):
    model = PieceModel(MODEL)
    for text in TEXTS + random_texts():
        ids, starts, ends = model.encode(text)
        assert ids.tolist() == library.encode(text)
        assert model.decode(ids) == library.decode(ids.tolist())
        proto = library.encode(text, return_type="proto")
        assert [(p.begin, p.end) for p in proto.pieces] == list(zip(starts.tolist(), ends.tolist(), strict=True)), text


def test_decoding_of_arbitrary_ids(library):
    import numpy as np

    rng, model = random.Random(9), PieceModel(MODEL)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), 1, 2]) for _ in range(rng.randint(1, 12))]
        assert model.decode(np.array(ids, np.int32)) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf"])
def test_normalisation_by_the_compiled_map(rule):
    sentencepiece = pytest.importorskip("sentencepiece")
    if not hasattr(sentencepiece, "SentencePieceNormalizer"):
        pytest.skip("this sentencepiece has no normalizer")
    from sentencepiece import sentencepiece_model_pb2 as proto

    for squeeze in (False, True):
        other = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
        spec = proto.ModelProto()
        spec.ParseFromString(other.serialized_model_proto())
        model = PieceModel(MODEL)
        model.map, model.squeeze = CharacterMap(spec.normalizer_spec.precompiled_charsmap), squeeze
        for text in ["ﬁne ＡＢＣ ①  é é", "  Ⅷ  x ", "カ゛", "plain", "", "   ", "ÀB　c"]:
            even, ends, sources = model.normalise(text)
            assert even == other.normalize(text), (text, squeeze)
            assert len(ends) == len(sources) and ends[-1] == len(even.encode()) and (ends[1:] >= ends[:-1]).all() and sources[-1] <= len(text.encode())


def test_encoding_query_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (None, "a b"), (3, TEXTS[3])]
    out = encode_and_decode(h.documents(spark, rows).withColumn("ids", F.lit(1)), MODEL).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in out) == Counter((d, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for d, t in rows)
    assert encode_and_decode(h.documents(spark, []), MODEL).count() == 0


# -- token counts ---------------------------------------------------------


def test_counts_are_those_of_the_unigram_tokenizer(spark):
    from sentencepiece import sentencepiece_model_pb2 as proto
    from tokenizers import Tokenizer, models, pre_tokenizers

    model = proto.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    vocabulary = [("<unk>", 0.0)] + [(p.piece, p.score) for p in model.pieces if p.type == 1] + [(p.piece, 0.0) for p in model.pieces if p.type == 6]
    other = Tokenizer(models.Unigram(vocabulary, 0, byte_fallback=True))
    other.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="first", split=True)
    counter = load(MODEL)
    for text in TEXTS + random_texts():
        assert counter.text(text) == len(other.encode(text, add_special_tokens=False).ids), text
    out = token_counts(h.documents(spark, [(1, None), (None, ""), (2, "a b"), (2, "a b")]), MODEL).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_chars) for r in out) == [("1", 0, 0), ("2", 2, 3), ("2", 2, 3), ("None", 0, 0)]
    assert token_counts(h.documents(spark, []), MODEL).count() == 0


def test_ties_and_unknowns_against_all_paths():
    from tokenizers import Tokenizer, models

    pieces = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁", -1.0)]
    for fallback in (False,):
        mine = UnigramCounter(pieces, fallback)
        other = Tokenizer(models.Unigram([("<unk>", -1.0), *pieces], 0, byte_fallback=fallback))
        rng = random.Random(2)
        for _ in range(400):
            word = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9)))
            assert mine.word(word) == len(other.encode(word).ids), word


# -- quality rules --------------------------------------------------------


def base_counts(text):
    words = h.WORD.findall(text)
    n, seen, dup = len(words), set(), 0
    for line in text.split("\n"):
        if h.WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    covered = {j for i in range(n - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_base_counts_against_brute_force(spark):
    rng = random.Random(6)
    texts = ["", " \n ", "a b c d e a b c d e", "x " * 50, "é ü " * 12, "\n".join(["same line here"] * 4 + ["other"]), "# $ a|b <c>\r\n\x0bz"]
    for _ in range(60):
        texts.append("".join(rng.choice(["a", "b", "cc", " ", " ", "\n", "\t", "#"]) for _ in range(rng.randint(1, 400))))
    texts.append(" ".join(h.words(rng, 20_000)))
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (None, "b " * 12)]
    got = {r.doc_id: r for r in quality_rules(h.documents(spark, rows).withColumn("kept", F.lit(5))).collect()}
    for d, t in rows:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(t or ""), d
        assert not (r.base_failed and r.kept)


def corpus(rng):
    rows = []
    for d in range(40):
        body = "\n".join(" ".join(h.words(rng, 12)) for _ in range(4))
        rows.append((d, f"Read  More HERE about us\n{body}" if d < 15 else body, "a" if d < 30 else None))
    for d in range(100, 130):  # mostly boilerplate, each with a line of its own
        rows.append((d, "\n".join(["alpha beta gamma delta epsilon zeta eta theta"] * 1 + ["one two three four five six seven eight nine"] + [" ".join(h.words(rng, 5))]), "b"))
    copy = "\n".join(" ".join(h.words(rng, 12)) for _ in range(6))
    rows += [(d, copy, "c") for d in range(200, 230)]
    for d in range(300, 330):  # near copies: one line of eight differs
        lines = copy.split("\n") + ["w " + " ".join(h.words(rng, 6))]
        rows.append((d, "\n".join(lines), "d"))
    return rows


def test_common_lines_are_cut_and_depleted_documents_go(spark):
    rows = corpus(random.Random(12))
    df = h.documents(spark, rows)
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    assert all(got[d].kept for d in range(40)) and all(got[d].n_removed_words == (5 if d < 15 else 0) for d in range(40))
    assert all(got[d].depleted and not got[d].kept for d in range(100, 130))
    assert all(got[d].kept for d in range(200, 230))  # copies are one document
    assert all(got[d].depleted for d in range(300, 330))  # near copies are 30 documents of the host
    clean = {r.doc_id: r for r in quality_rules(df, clean=True).collect()}
    assert set(clean) == {d for d in got if got[d].kept}
    assert clean[3].text == rows[3][1].split("\n", 1)[1] and clean[3].n_chars == len(clean[3].text)
    assert clean[20].text == rows[20][1]


def test_quality_rules_on_odd_tables(spark):
    assert quality_rules(h.documents(spark, [])).count() == 0
    assert quality_rules(h.documents(spark, []), clean=True).count() == 0
    long = " ".join(h.words(random.Random(1), 30))
    df = h.documents(spark, [(1, long), (1, long), (None, long), (2, None)])
    for name in ("key_a", "key_b", "body", "host", "common", "Kept", "lines", "h"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    clean = quality_rules(df, clean=True)
    assert clean.columns == df.columns and clean.count() == 3
    assert all(r[c] == f"own {c}" for r in clean.collect() for c in df.columns[5:])
    assert quality_rules(df.drop("source")).count() == 4


def brute_verdicts(rows):
    """doc_id: (words in common lines, kept)."""
    texts, lines = {}, {}
    for _, text, host in rows:
        texts.setdefault(host, set()).add(text)
        for line in text.split("\n"):
            lines.setdefault((host, " ".join(h.WORD.findall(line)).lower()), set()).add(text)
    out = {}
    for d, text, host in rows:
        gone = 0
        for line in text.split("\n"):
            even = " ".join(h.WORD.findall(line)).lower()
            n = len(lines[host, even])
            if even and n > 10 and 100 * n > 5 * len(texts[host]):
                gone += len(even.split())
        base = base_counts(text)
        out[d] = gone, not base[5] and 100 * gone <= 50 * base[0]
    return out


def test_line_verdicts_against_brute_force(spark):
    rng, rows = random.Random(17), []
    for k in (1, 3, 6, 12, 20):  # k shared lines and one own line: all are removed, the documents depleted
        shared = [" ".join(h.words(rng, 9)) for _ in range(k)]
        rows += [(1000 * k + d, "\n".join([*shared, " ".join(h.words(rng, 5))]), f"host{k}") for d in range(200)]
    pool = [" ".join(h.words(rng, 8)) for _ in range(60)]
    for d in range(300):  # lines of all frequencies around both limits
        own = [rng.choice(pool[: rng.choice([3, 20, 60])]) for _ in range(rng.randint(0, 4))] + [" ".join(h.words(rng, rng.randint(4, 30)))]
        rows.append((30_000 + d, "\n".join(own), "small" if d % 5 == 0 else "wide"))
    rows += [(40_000 + d, rows[0][1], "host1") for d in range(500)]  # many copies are one text
    got = {r.doc_id: (r.n_removed_words, r.kept) for r in quality_rules(h.documents(spark, rows)).collect()}
    assert got == brute_verdicts(rows)
    assert not any(kept for d, (_, kept) in got.items() if d < 30_000)


def test_common_lines_are_a_share_of_the_host(spark):
    rng = random.Random(14)

    def body(lines):
        return "\n".join(" ".join(h.words(rng, 12)) for _ in range(lines))

    # 20 of 500 texts share a line by chance; 60 of 500 have a footer.
    rows = [(d, ("les.\n" if d < 20 else "") + body(3) + ("\nall rights reserved" if d >= 440 else ""), "large") for d in range(500)]
    got = {r.doc_id: r for r in quality_rules(h.documents(spark, rows)).collect()}
    assert all(got[d].n_removed_words == (3 if d >= 440 else 0) for d in range(500))


# -- decontamination ------------------------------------------------------


def brute_contamination(docs, items, width=5, least=0.8):
    out = set()
    for d, text in docs:
        words = h.WORD.findall(h.lower(text or ""))
        for i, item in items:
            own = h.WORD.findall(h.lower(item or ""))
            k = min(width, len(own))
            if not own:
                continue
            bag = Counter(tuple(own[j : j + k]) for j in range(len(own) - k + 1))
            for s in range(len(words) - len(own) + 1):
                win = Counter(tuple(words[s + j : s + j + k]) for j in range(len(own) - k + 1))
                if sum((bag & win).values()) >= least * sum((bag | win).values()):
                    out.add((d, i))
                    break
    return out


def test_contamination_against_brute_force(spark):
    rng = random.Random(21)
    items = [(i, " ".join(h.words(rng, rng.choice([1, 3, 5, 9, 30, 45, 60])))) for i in range(25)] + [(90, None), (91, " "), (92, "a a a a a a a a b")]
    docs = []
    for d in range(60):
        body = h.words(rng, rng.randint(0, 150))
        if d % 2:
            item = rng.choice(items)[1]
            own = (item or "").upper().split()
            for _ in range(rng.randint(0, 2)):
                if own:
                    own[rng.choice([0, -1, rng.randrange(len(own))])] = "changed"
            body[len(body) // 2 : len(body) // 2] = own * rng.choice([1, 1, 2])
        docs.append((d, " ".join(body)))
    docs += [(70, None), (71, ""), (None, items[5][1]), (72, "x a a a a a a a a a b y")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3))
    df = h.documents(spark, docs).withColumn("item_id", F.lit("z"))
    found = dc.contamination(df, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute_contamination(docs, items)
    passes = dc.contamination(df, benchmark, items_a_pass=4).collect()
    assert Counter(passes) == Counter(found)
    kept = dc.decontaminate(df, benchmark)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in docs if d is None or d not in {r.doc_id for r in found})
    assert dc.contamination(df, benchmark.limit(0)).count() == 0 and dc.contamination(df.limit(0), benchmark).count() == 0


def test_items_cut_short_at_an_end_are_found(spark):
    rng = random.Random(33)
    item = h.words(rng, 100)
    cut = {1: item[:95], 2: item[3:], 3: item[:85], 4: item[:80], 5: item[:99], 6: item, 7: item[2:98]}
    docs = h.documents(spark, [(d, " ".join(w)) for d, w in cut.items()])
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(h.words(rng, 20)))], "item_id long, text string")
    found = {r.doc_id: r for r in dc.contamination(docs, benchmark).collect()}
    assert set(found) == {1, 2, 3, 5, 6, 7}  # 76 of 96 shingles are too few
    for d, r in found.items():
        assert (r.item_id, r.start_word, r.n_words) == (1, 0, len(cut[d]))
        assert abs(r.similarity - (len(cut[d]) - 4) / 96) < 1e-12
    assert {r.doc_id for r in dc.decontaminate(docs, benchmark).collect()} == {4}


def test_windows_within_the_radius_are_candidates():
    import numpy as np

    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (200, dc.BITS // 8), dtype=np.uint8)
    index = dc.MultiIndex(a)
    for _ in range(40):
        own = rng.integers(200, size=5)
        bits = np.unpackbits(a[own], axis=1)
        for row in bits:
            row[rng.permutation(dc.BITS)[: int(rng.integers(0, dc.RADIUS + 1))]] ^= 1
        rows, items = index.candidates(np.packbits(bits, axis=1))
        pairs = set(zip(rows.tolist(), items.tolist(), strict=True))
        assert len(pairs) == len(rows) and all((k, int(i)) in pairs for k, i in enumerate(own))


def test_repeated_items_and_long_documents(spark):
    rng = random.Random(41)
    item = " ".join(h.words(rng, 30))
    benchmark = spark.createDataFrame([(1, item)] * 500 + [(2, item)], "item_id long, text string")
    long = " ".join(h.words(rng, 60_000))
    docs = h.documents(spark, [(1, f"{long} {item} {long}"), (1, item), (2, long)])
    found = Counter((r.doc_id, r.item_id, r.start_word) for r in dc.contamination(docs, benchmark, items_a_pass=1).collect())
    assert found == Counter({(1, 1, 60_000): 1, (1, 2, 60_000): 1, (1, 1, 0): 1, (1, 2, 0): 1})
