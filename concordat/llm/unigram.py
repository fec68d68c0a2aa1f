"""Count-only Viterbi for unigram vocabularies (operator 7).

How many tokens a unigram tokenizer makes of a text, without making them.  An
Aho-Corasick automaton enumerates all vocabulary matches in a marked word; the
dynamic program carries, for each end, the best score, its piece count and
nothing else.  Ties are the tokenizer's: a path replaces another only if its
score is greater, and paths come in the order of their last piece's start, so
at equal scores the longest last piece stays.  A character that no one-character
piece covers may also become an unknown, scored 10 below the vocabulary's
least score, and counts as its UTF-8 bytes if the vocabulary has byte pieces;
without them, neighbouring unknowns count as one.

Words are split as the ``tokenizers`` library's metaspace rule does: a mark
stands for each space and before the text, and every mark begins a word.

Scale: rows are independent and nothing is shuffled; each worker process keeps
the counts of the words that it has seen in a table of bounded size.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 400_000
#: From one mark to before the next.
_WORD = re.compile(f"{MARK}[^{MARK}]*|[^{MARK}]+")


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        self.bytes = byte_fallback
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of one marked word."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        single = [False] * n
        for end, (length, score) in self.automaton.iter(word):
            ends[end].append((length, score))
            if length == 1:
                single[end] = True
        # For each end: best score, tokens up to it, and whether it ends in an unknown.
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            best = None
            # Longest first: the order of starts.  The unknown comes after all pieces of its start, and is the shortest.
            for length, own in sorted(ends[end - 1], reverse=True):
                start = end - length
                total = score[start] + own
                if best is None or total > best:
                    best, score[end], count[end], unknown[end] = total, total, count[start] + 1, False
            if not single[end - 1]:
                total = score[end - 1] + self.unknown
                if best is None or total > best:
                    width = len(word[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else int(not unknown[end - 1])
                    score[end], count[end], unknown[end] = total, count[end - 1] + width, True
        return count[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        if not marked.startswith(MARK):
            marked = MARK + marked
        known, total = self.known, 0
        for word in _WORD.findall(marked):
            n = known.get(word)
            if n is None:
                n = self.word(word)
                if len(word) < 200:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = n
            total += n
        return total


@lru_cache(maxsize=2)
def load(path: str) -> UnigramCounter:
    """The normal pieces and scores of a SentencePiece model file, taken as a unigram vocabulary."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    pieces = [(p.piece, p.score) for p in model.pieces if p.type == 1]
    return UnigramCounter(pieces, any(p.type == 6 for p in model.pieces))


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, n_chars, n_bytes) of the whole text of every row of ``docs`` (doc_id, text).

    A null or empty text has 0 tokens.  doc_id is passed through, nulls and
    repeats too; other columns are not looked at.
    """

    def run(batches):
        counter = load(model_path)
        for batch in slices(batches):
            counts = [counter.text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), batch.column("n_chars"), batch.column("n_bytes")], ["doc_id", "n_tokens", "n_chars", "n_bytes"])

    text = text_or_empty()
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.octet_length(text).cast("long").alias("n_bytes"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, n_chars long, n_bytes long")
