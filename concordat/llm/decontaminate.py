"""Benchmark decontamination with SimHash windows (operator 5).

A document is slid over with windows as long as the items, a window is the
weighted set of its 5-word shingles (the weight is how often one occurs), and
its SimHash is 256 signs of the weighted sum of the shingles' hash bits.
Fingerprints of items are found by a multi-index: 16 blocks of 16 bits, each a
table from block values to items.  Every item is entered under the values
within one wrong bit of its own, and a window asks for the values within two of
its own, so that by pigeonhole all items within Hamming distance 63 are among
the candidates.  At a weighted Jaccard similarity of 0.8 the expected distance
is 39 with a deviation of 6.  Candidates within that radius are confirmed by
the similarity, computed exactly.

A document of fewer words than an item is one window as a whole, so an item
that was cut short at an end is found as well.

A window of n shingles can only be as similar to an item of n shingles as asked
if so many of its shingles occur in items of that length; of windows with
fewer no fingerprint is made.  This drops nothing and saves the work on clean
text.

Scale: documents are never shuffled.  Items come in passes of bounded size
(``items_a_pass`` items and ``bytes_a_pass`` bytes of text), one broadcast and
one scan for each pass, however large the benchmark is.
"""

from __future__ import annotations

import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, shingle_hashes, slices, text_or_empty, word_hashes

BITS, BLOCKS = 256, 16
#: Wrong bits of a block under which items are entered, and under which windows look.
ENTERED, ASKED = 1, 2
RADIUS = BLOCKS * (ENTERED + ASKED + 1) - 1
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, distance int, similarity double"
_SALTS = np.array([0xA5A5A5A5A5A5A5A5, 0, 0x3C6EF372FE94F82B, 0x510E527FADE682D1], np.uint64)


def sign_matrix(shingles: np.ndarray) -> np.ndarray:
    """+1 and -1 for each of the 256 hash bits of each shingle."""
    words = mix(shingles[:, None] ^ _SALTS[None, :])
    bits = np.unpackbits(words.view(np.uint8).reshape(len(shingles), BITS // 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """32 bytes for each row of 256 sums."""
    return np.packbits(sums > 0, axis=1)


def _flips(most: int) -> np.ndarray:
    """All changes of at most ``most`` bits of a block."""
    return np.array([sum(1 << p for p in places) for k in range(most + 1) for places in combinations(range(16), k)], np.uint16)


class MultiIndex:
    """Items by block value: ``of[b]`` to ``of[b + 1]`` are the entries of a block and value, in ``items``."""

    def __init__(self, prints: np.ndarray):
        blocks = prints.view(np.uint16)
        flips = _flips(ENTERED)
        places = (np.arange(BLOCKS, dtype=np.int64) << 16)[None, :, None] + (blocks[:, :, None] ^ flips).astype(np.int64)
        owner = np.broadcast_to(np.arange(len(prints), dtype=np.int32)[:, None, None], places.shape).ravel()
        places = places.ravel()
        order = np.argsort(places, kind="stable")
        self.items = owner[order]
        self.of = np.searchsorted(places[order], np.arange((BLOCKS << 16) + 1))
        self.flips = _flips(ASKED)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``prints``, item), each pair once, of all that some block brings together."""
        rows, items = [], []
        for at in range(0, len(prints), 256):
            blocks = prints[at : at + 256].view(np.uint16)
            asked = (np.arange(BLOCKS, dtype=np.int64) << 16)[None, :, None] + (blocks[:, :, None] ^ self.flips).astype(np.int64)
            asked = asked.reshape(len(blocks), -1)
            counts = self.of[asked + 1] - self.of[asked]
            row, place = np.nonzero(counts)
            n = counts[row, place]
            start = np.repeat(self.of[asked[row, place]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            own = np.repeat(row + at, n)
            pairs = np.unique(own.astype(np.int64) << 32 | self.items[start + np.arange(len(own))])
            rows.append(pairs >> 32)
            items.append(pairs & 0xFFFFFFFF)
        return np.concatenate(rows), np.concatenate(items)


class Index:
    """The items of one pass: shingles of all, their fingerprints and the multi-index of these."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.width = width
        by_length: dict[int, list] = {}
        owners: dict[int, dict[int, set]] = {}
        for item_id, text in items:
            words = word_hashes(text or "")
            if not len(words):
                continue
            n, k = len(words), min(width, len(words))
            values, counts = np.unique(shingle_hashes(words, k), return_counts=True)
            by_length.setdefault(n, []).append((item_id, values, counts))
            for v in values.tolist():
                owners.setdefault(k, {}).setdefault(v, set()).add(n)
        #: by shingle width: sorted hashes, and the item lengths in which each occurs
        self.shingles = {k: (np.array(sorted(d), np.uint64), [sorted(d[v]) for v in sorted(d)]) for k, d in owners.items()}
        self.rows = [row for rows in by_length.values() for row in rows]
        self.words = np.array([n for n, rows in by_length.items() for _ in rows], np.int64)
        self.prints = fingerprints(np.stack([(sign_matrix(v) * c[:, None]).sum(axis=0) for _, v, c in self.rows])) if self.rows else np.zeros((0, BITS // 8), np.uint8)
        self.index = MultiIndex(self.prints)

    def find(self, text: str, least: float) -> list[tuple[int, int, int, int, float]]:
        """(item_id, start_word, n_words, distance, similarity) of the best windows that don't overlap."""
        words = word_hashes(text)
        out = []
        for k, (known, lengths) in self.shingles.items():
            if len(words) < k:
                continue
            shingles = shingle_hashes(words, k)
            at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
            hits = np.flatnonzero(known[at] == shingles)
            if not len(hits):
                continue
            wanted: dict[int, list[int]] = {}
            for place in hits.tolist():
                for n in lengths[at[place]]:
                    wanted.setdefault(n, []).append(place)
            for n, places in wanted.items():
                if min(self.width, n) == k:
                    out += self._windows(shingles, np.array(places), n, min(n, len(words)), k, least)
        return out

    def _windows(self, shingles, places, n, held, k, least):
        """The best windows of ``held`` words for the items of n words; a shorter document is one window."""
        size, whole = held - k + 1, n - k + 1
        if size < least * whole:  # so few shingles can't be as similar
            return []
        last = len(shingles) - size
        hit = np.zeros(len(shingles) + 1, np.int64)
        hit[places + 1] = 1
        hit = np.cumsum(hit)
        # Shared weight is at most the number of shingles that some item of this length has.
        shared = hit[size:] - hit[: last + 1]
        starts = np.flatnonzero(shared >= least * (size + whole - shared) - 1e-9)
        found: dict[int, list] = {}
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
            for at in range(0, len(part), 2048):
                some = part[at : at + 2048]
                low, high = int(some[0]), int(some[-1]) + size
                running = np.zeros((high - low + 1, BITS), np.int32)
                np.cumsum(sign_matrix(shingles[low:high]), axis=0, out=running[1:])
                own = fingerprints(running[some - low + size] - running[some - low])
                window, item = self.index.candidates(own)
                same = self.words[item] == n
                window, item = window[same], item[same]
                distance = np.bitwise_count(own[window] ^ self.prints[item]).sum(axis=1, dtype=np.int64)
                for w, i, d in zip(window.tolist(), item.tolist(), distance.tolist(), strict=True):
                    if d <= RADIUS:
                        found.setdefault(i, []).append((int(some[w]), d))
        out = []
        for i, windows in found.items():
            item_id, values, counts = self.rows[i]
            checked = []
            for start, distance in windows:
                own = shingles[start : start + size]
                at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                shared = np.bincount(at[values[at] == own], minlength=len(values))
                both = int(np.minimum(shared, counts).sum())
                similarity = both / (size + whole - both)
                if similarity >= least:
                    checked.append((-similarity, start, distance))
            taken: list[int] = []
            for minus, start, distance in sorted(checked):
                if all(abs(start - t) >= held for t in taken):
                    taken.append(start)
                    out.append((item_id, start, held, distance, -minus))
        return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8, items_a_pass: int = 5000, bytes_a_pass: int = 8_000_000) -> DataFrame:
    """One row for each passage of ``docs`` (doc_id, text) that is as similar to an item of ``benchmark`` (item_id, text).

    Columns: doc_id, item_id, start_word and n_words of the passage,
    SimHash distance and similarity.  Of overlapping windows the most similar
    one is given, the earlier one at a tie.  Items of fewer than ``width``
    words are one shingle; a document shorter than an item is one passage;
    items and documents without words match nothing.
    Null doc_ids and item_ids are passed through; repeated rows of ``docs`` give
    repeated rows, repeated rows of ``benchmark`` count once; other columns are
    not looked at.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).distinct()
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-n // items_a_pass), -(-size // bytes_a_pass))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    out = None
    for turn in range(passes):
        dealt = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == turn)
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r.item_id, r.text) for r in dealt.toLocalIterator()]))
        found = narrow.mapInArrow(_scanner(shared, width, similarity), SCHEMA)
        out = found if out is None else out.union(found)
    return out


_indexes: dict[tuple[str, int], Index] = {}


def _index_of(shared, width: int) -> Index:
    """The index of a pass, built once in each worker process; only the last one is kept."""
    name, items = shared.value
    if (name, width) not in _indexes:
        _indexes.clear()
        _indexes[name, width] = Index(items, width)
    return _indexes[name, width]


def _scanner(shared, width: int, least: float):
    def run(batches):
        index = _index_of(shared, width)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += [(doc_id, *hit) for hit in index.find(text or "", least)]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no passage of an item is found; rows without doc_id stay."""
    return docs.join(contamination(docs, benchmark, **options).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
