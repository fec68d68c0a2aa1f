"""Language identification of mixed texts (operator 10).

A word is a run of letters of one script, cut into pieces of 64 letters where it
is longer, as in scripts written without spaces.  Each word is scored for each
language by the character trigrams of the marked word, with log-probabilities
learned from labelled texts.  Its script narrows the candidates to languages
written in it.  A Viterbi pass over the words, with a penalty for each change
of language, labels the whole text; runs of equal labels are spans.  The
predicted language is the one with the most letters.

The pass runs over many texts at once: step t handles word t of every text
that has one, in numpy, so its cost in Python is that of the longest text of a
batch.

Scale: counts of the training sample are summed by Spark, only the trigram
table of bounded size comes to the driver, and prediction is one scan without
a shuffle.
"""

from __future__ import annotations

import math
import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, text_or_empty
from .quality_model import held_out

# First code points of script ranges; the gaps between them count as the range before.
_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x30000, "other"),
]
_STARTS = [a for a, _ in _RANGES]
#: Trigrams of a language at least, however many languages there are.
LEAST_TRIGRAMS = 300
#: Letters of a word; longer runs are several words.
LETTERS = 64
REMEMBERED = 300_000
CHARS = 8_000_000


def _letter_runs() -> dict[str, str]:
    """script: its letters (of Unicode's letter categories) as the inside of a character class."""
    out: dict[str, list[str]] = {}
    bounds = [*_STARTS[1:], sys.maxunicode + 1]
    for (first, name), end in zip(_RANGES, bounds, strict=True):
        start = None
        for c in range(first, end + 1):
            if c < end and chr(c).isalpha():
                start = c if start is None else start
            elif start is not None:
                out.setdefault(name, []).append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
                start = None
    return {name: "".join(runs) for name, runs in out.items()}


_PIECE = re.compile("|".join(f"[{runs}]{{1,{LETTERS}}}" for runs in _letter_runs().values()))
#: A run of letters, and of numbers like ½ and Ⅷ that the pattern language counts with them; most are one word.
RUN = re.compile(r"[^\W\d_]+")


def whole(run: str) -> bool:
    """Whether a run is one word: short, of letters only, and of one script."""
    return len(run) <= LETTERS and (run.isascii() or (run.isalpha() and len({script(c) for c in run}) == 1))


def words_of(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every word."""
    for m in RUN.finditer(text):
        if whole(m.group()):
            yield m.span()
        else:
            yield from (p.span() for p in _PIECE.finditer(text, m.start(), m.end()))


def script(word: str) -> str:
    return _RANGES[bisect_right(_STARTS, ord(word[0])) - 1][1]


def trigrams(word: str) -> list[str]:
    marked = f"^{word.lower()}$"
    return [marked[i : i + 3] for i in range(len(marked) - 2)]


@dataclass
class LanguageModel:
    languages: list[str]
    #: trigram: its row in ``table``
    rows: dict[str, int]
    #: log-probabilities by language; the last row is that of a trigram never seen
    table: np.ndarray
    #: script: whether each language is written in it
    scripts: dict[str, np.ndarray]
    switch: float
    #: the most that one word may speak for one language over another
    most: float

    def words(self, words: list[str]) -> np.ndarray:
        """Scores of words by language, the best one 0; impossible scripts far below."""
        get, other = self.rows.get, len(self.table) - 1
        places, starts, allowed = [], [], []
        everywhere = np.ones(len(self.languages), bool)
        unknown = np.zeros(len(words), bool)
        for k, word in enumerate(words):
            starts.append(len(places))
            places += [get(g, other) for g in trigrams(word)]
            own = self.scripts.get(script(word))
            unknown[k] = own is None or not own.any()
            allowed.append(everywhere if unknown[k] else own)
        total = np.add.reduceat(self.table[places], starts, axis=0)
        fit = np.stack(allowed)
        best = np.where(fit, total, -np.inf).max(axis=1, keepdims=True)
        scores = np.where(fit, np.maximum(total - best, -self.most), -1e6)
        scores[unknown] = 0
        return scores


class _Words:
    """The words of a worker process with their scores, in a table that starts anew beyond a bound."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.words: list[str] = []
        self.broken: list[np.ndarray] = []
        # Grown by doubling; rows beyond those of self.words are not in use.
        self.scores = np.zeros((1024, len(self.model.languages)))
        self.letters = np.zeros(1024, np.int64)

    def take(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's words as rows of the table."""
        if len(self.places) > REMEMBERED:
            self.clear()
        places, new, out = self.places, [], []

        def place(word: str) -> int:
            if word not in places:
                places[word] = len(self.words)
                self.words.append(word)
                new.append(word)
            return places[word]

        for text in texts:
            found = RUN.findall(text)
            for run in found:
                if run not in places:
                    if whole(run):
                        place(run)
                    else:
                        # A run of several words stands for them by a negative number.
                        own = [place(w) for w in _PIECE.findall(run)]
                        self.broken.append(np.array(own, np.int64))
                        places[run] = -len(self.broken)
            at = np.fromiter(map(places.__getitem__, found), np.int64, len(found))
            if len(at) and at.min() < 0:
                at = np.concatenate([self.broken[-k - 1] if k < 0 else [k] for k in at.tolist()]).astype(np.int64)
            out.append(at)
        if new:
            n = len(self.words)
            if n > len(self.letters):
                size = 1 << n.bit_length()
                self.scores = np.concatenate([self.scores, np.zeros((size - len(self.scores), self.scores.shape[1]))])
                self.letters = np.concatenate([self.letters, np.zeros(size - len(self.letters), np.int64)])
            self.scores[n - len(new) : n] = self.model.words(new)
            self.letters[n - len(new) : n] = np.fromiter(map(len, new), np.int64, len(new))
        return out


def viterbi(words: list[np.ndarray], scores: np.ndarray, switch: float) -> list[np.ndarray]:
    """The best language of each word for each text, given as indexes into the rows of ``scores``."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(-lengths, kind="stable")
    count = len(order)
    longest = int(lengths.max()) if count else 0
    active = np.searchsorted(-lengths[order], -np.arange(longest), "left")  # texts with more than t words
    begin = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty(begin[-1], np.int64)
    for rank, i in enumerate(order):
        flat[begin[: lengths[i]] + rank] = words[i]
    k = scores.shape[1]
    stay = np.arange(k)
    back = np.empty((len(flat), k), np.int8 if k < 127 else np.int16)
    best = None
    last = np.zeros((count, k))
    for t in range(longest):
        n = int(active[t])
        here = scores[flat[begin[t] : begin[t + 1]]]
        if best is None:
            best = here.copy()
            back[: len(here)] = stay
        else:
            last[n : len(best)] = best[n:]
            best = best[:n]
            top = best.argmax(axis=1)
            jump = best[np.arange(n), top] - switch
            changed = jump[:, None] > best
            back[begin[t] : begin[t + 1]] = np.where(changed, top[:, None], stay)
            best = np.where(changed, jump[:, None], best) + here
    if best is not None:
        last[: len(best)] = best
    state = last.argmax(axis=1)
    labels = np.empty(len(flat), back.dtype)
    for t in range(longest - 1, -1, -1):
        n = int(active[t])
        labels[begin[t] : begin[t + 1]] = state[:n]
        state[:n] = back[begin[t] : begin[t + 1]][np.arange(n), state[:n]]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * count
    for rank, i in enumerate(order):
        out[i] = labels[begin[: lengths[i]] + rank]
    return out


def train(docs: DataFrame, out_part: int = 1, of: int = 3, sample_docs: int = 4000, most_trigrams: int = 60_000, switch: float = 12.0, most: float = 8.0) -> LanguageModel:
    """A model from text and lang of documents that aren't held out.

    Fit on at most ``sample_docs`` documents of each language, those with the
    least hashes of their doc_id, and on each language's most frequent
    trigrams, of which every language has an equal share of ``most_trigrams``
    (``LEAST_TRIGRAMS`` at least); a doc_id that occurs again with the same lang counts
    once, by its least text.  Null texts and null langs are left out.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(out_part, of)).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    scratch = Scratch(docs.sparkSession, "language")
    # Only the lower part of the hashes goes to the ranking, about four samples of a language however many documents it has; the least hashes are all in it.
    sizes = scratch.save(usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("of")), "sizes")
    low = (F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(2.0**53)) * F.col("of") < 4.0 * sample_docs
    ids = usable.join(sizes, "lang").where(low).select("doc_id", "lang").distinct()
    rank = Window.partitionBy("lang").orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 11), "doc_id")
    ids = scratch.save(ids.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= sample_docs).drop("rank"), "ids")
    names = sorted(r.lang for r in ids.select("lang").distinct().collect())
    if not names:
        return LanguageModel([], {}, np.zeros((1, 0)), {}, switch, most)

    def count(batches):
        counts: dict[tuple[str, str], int] = {}
        letters: dict[tuple[str, str], int] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for start, end in words_of(text):
                    w = text[start:end]
                    s = script(w)
                    letters[lang, s] = letters.get((lang, s), 0) + len(w)
                    for g in trigrams(w):
                        counts[lang, g] = counts.get((lang, g), 0) + 1
        for rows, kind in ((counts, "gram"), (letters, "script")):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows]), pa.array([kind] * len(rows)), pa.array([b for _, b in rows]), pa.array(list(rows.values()), pa.int64())], ["lang", "kind", "name", "n"])

    sample = usable.join(ids, ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")
    summed = sample.mapInArrow(count, "lang string, kind string, name string, n long").groupBy("kind", "name", "lang").agg(F.sum("n").alias("n"))
    summed = scratch.save(summed, "counts")
    share = max(LEAST_TRIGRAMS, most_trigrams // len(names))
    often = Window.partitionBy("lang").orderBy(F.desc("n"), "name")
    chosen = summed.where("kind = 'gram'").withColumn("place", F.row_number().over(often)).where(F.col("place") <= share).select("kind", "name").distinct()
    by_name = summed.groupBy("kind", "name").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n"))
    rows = by_name.join(chosen, ["kind", "name"], "left_semi").orderBy("name").collect()
    kinds = by_name.where("kind = 'script'").limit(len(_RANGES)).collect()
    place = {n: i for i, n in enumerate(names)}
    counts = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        for lang, n in r.n.items():
            counts[i, place[lang]] = n
    logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * (len(rows) + 1)))
    unseen = np.log(0.5 / (counts.sum(axis=0) + 0.5 * (len(rows) + 1)))
    written = {r.name: np.array([r.n.get(n, 0) for n in names], float) for r in kinds}
    totals = sum(written.values(), np.zeros(len(names)))
    scripts = {s: n > 0.01 * np.maximum(totals, 1) for s, n in written.items()}
    # A trigram never seen says nothing for one language over another.
    table = np.concatenate([logs, np.full((1, len(names)), unseen.mean())])
    return LanguageModel(names, {r.name: i for i, r in enumerate(rows)}, table, scripts, switch, most)


SCHEMA = "doc_id long, lang_pred string, score double, spans array<struct<start int, end int, lang string>>"


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, spans) for every row of ``docs`` (doc_id, text).

    Spans are code point ranges [start, end) that cover the words from first to
    last.  ``score`` is the predicted language's share of the letters times its
    posterior (``_posterior``); in a script that was never learned every
    language is as likely.  A text
    that is null or without letters is ``und`` with score 0 and no span; so is
    every text if nothing was learned.  At equal shares the first language in
    the alphabet is given.  doc_id is passed through, nulls and repeats too;
    other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        names = model.languages
        words = _Words(model)
        for batch in batches:
            for part in slices([batch], rows=4096, chars=CHARS):
                texts = [t or "" for t in part.column("text").to_pylist()]
                indexed = words.take(texts) if names else [np.zeros(0, np.int64)] * len(texts)
                paths = viterbi(indexed, words.scores, model.switch) if names else indexed
                letters = words.letters
                out = []
                for i, (text, own) in enumerate(zip(texts, indexed, strict=True)):
                    if not len(own):
                        out.append(("und", 0.0, []))
                        continue
                    by = np.bincount(paths[i], letters[own], minlength=len(names))
                    best = int(by.argmax())
                    out.append((names[best], float(by[best] / by.sum()) * _posterior(words.scores[own], best), _spans(text, paths[i], names)))
                preds, shares, spans = zip(*out, strict=True)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(preds, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return narrow.mapInArrow(run, SCHEMA)


def _posterior(scores: np.ndarray, best: int) -> float:
    """How likely the language is by the words' scores, which are summed as if only the square root of their number were independent."""
    total = np.maximum(scores, -50.0).sum(axis=0) / math.sqrt(len(scores))
    weight = np.exp(total - total.max())
    return float(weight[best] / weight.sum())


def _spans(text: str, path: np.ndarray, names: list[str]) -> list[dict]:
    """Runs of equal labels; the words' places are only looked up where there is more than one."""
    turns = np.flatnonzero(np.diff(path)) + 1
    if not len(turns):
        first = next(words_of(text))[0]
        end = len(text)
        while not text[end - 1].isalpha():
            end -= 1
        return [{"start": first, "end": end, "lang": names[int(path[0])]}]
    places = list(words_of(text))
    bounds = [0, *turns.tolist(), len(path)]
    return [{"start": places[a][0], "end": places[b - 1][1], "lang": names[int(path[a])]} for a, b in zip(bounds, bounds[1:], strict=False)]
