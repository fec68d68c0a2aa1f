"""Vector code compression: product codes whose nearest entries are found by Orchard's search (operator 12).

A vector is cut into parts of equal length; each part is coded by the nearest
of a codebook's entries.  Every entry keeps the list of all entries sorted by
their distance from it.  A search stands at one entry and walks down its list;
a closer entry (or one as close with a lower index) is jumped to and its list
begun; entries seen before are skipped; and the walk stops at the first listed
entry farther from the present one than twice the present distance, since by
the triangle inequality neither it nor any after it can be closer or as close.
A batch of parts walks in step, one listed entry of each at a time.

All arithmetic is on integers: int64 where squares fit, else Python integers.

Scale: a round is one scan with partial sums in the tasks (parts of an entry are
counted and added up in each batch), merged by an aggregation of at most
``parts * entries * length`` groups; only these codebooks, whose size the
parameters and the vectors' length bound, go through the driver and to the
tasks.  Nothing of a row is shuffled but its label's share of the error.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import as_longs, finite_vectors, matrix, scaled_floor

#: Rows of a batch that walk in step.
STEP = 4096
#: Decimal digits of a limb, by which sums of any size cross Spark's aggregation.
LIMB = 10**18


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def _fitting(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as int64 if their squared distances times four fit, else as Python integers."""
    largest = max((int(abs(a).max()) if a.size else 0) for a in arrays)
    width = arrays[0].shape[-1]
    kind = np.int64 if 16 * largest * largest * max(width, 1) < 2**63 else object
    return [a.astype(kind) for a in arrays]


def neighbour_lists(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry all entries, itself first, by distance (ties to the lower index), and the squared distances."""
    apart = _squared(entries[:, None, :], entries[None, :, :])
    n = len(entries)
    apart[np.arange(n), np.arange(n)] = -1  # itself stands before its doubles
    order = np.argsort(apart, axis=1, kind="stable")
    apart[np.arange(n), np.arange(n)] = 0
    return order, np.take_along_axis(apart, order, axis=1)


def nearest(parts: np.ndarray, entries: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each part's nearest entry, ties to the lower index.

    ``start`` gives the entries where the searches begin; the first one if not given.
    """
    parts, entries = _fitting(parts, entries)
    order, apart = neighbour_lists(entries)
    n, k = len(parts), len(entries)
    at = np.zeros(n, np.int64) if start is None else start.astype(np.int64).copy()
    best = _squared(parts, entries[at])
    seen = np.zeros((n, k), dtype=bool)
    seen[np.arange(n), at] = True
    down = np.ones(n, np.int64)  # the list's first is the entry itself
    walking = np.arange(n) if k > 1 else np.zeros(0, np.int64)
    while len(walking):
        here, spot = at[walking], down[walking]
        # Squares: farther than twice the distance is more than four times the square.
        walking = walking[apart[here, spot] <= 4 * best[walking]]
        listed = order[at[walking], down[walking]]
        fresh = ~seen[walking, listed]
        asked, entry = walking[fresh], listed[fresh]
        seen[asked, entry] = True
        distance = _squared(parts[asked], entries[entry])
        better = (distance < best[asked]) | ((distance == best[asked]) & (entry < at[asked]))
        down[walking] += 1
        moved = asked[better]
        at[moved], best[moved], down[moved] = entry[better], distance[better], 1
        walking = walking[down[walking] < k]
    return at, best


def _parts(column: pa.Array, width: int, parts: int, scale: int) -> np.ndarray:
    """(rows, parts, length) integers."""
    whole = scaled_floor(matrix(column, width), scale)
    return whole.reshape(len(whole), parts, width // parts)


def _sums(batches, books: list[np.ndarray], width: int, scale: int):
    """(part, entry, place, high, middle, low, count) of what each batch adds to each entry."""
    names = ["part", "entry", "place", "high", "middle", "low", "n"]
    for batch in batches:
        for first in range(0, batch.num_rows, STEP):
            cut = _parts(batch.column("embedding").slice(first, STEP), width, len(books), scale)
            rows: list[list] = [[] for _ in names]
            for p, book in enumerate(books):
                code, _ = nearest(cut[:, p], book)
                for e in np.unique(code):
                    mine = cut[code == e, p]
                    small = mine.dtype != object and int(abs(mine).max(initial=0)) < 2**62 // len(mine)
                    total = mine.sum(axis=0) if small else mine.astype(object).sum(axis=0)
                    for i, t in enumerate(total.tolist()):
                        rest, low = divmod(int(t), LIMB)
                        high, middle = divmod(rest, LIMB)
                        for column, v in zip(rows, (p, int(e), i, str(high), middle, low, len(mine)), strict=True):
                            column.append(v)
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names)


def _coded(batches, books: list[np.ndarray], width: int, scale: int):
    for batch in batches:
        for first in range(0, batch.num_rows, STEP):
            part = batch.slice(first, STEP)
            cut = _parts(part.column("embedding"), width, len(books), scale)
            found = [nearest(cut[:, p], book) for p, book in enumerate(books)]
            error = sum((d.astype(object) if d.dtype == object or int(d.max(initial=0)) > 2**60 // len(books) else d) for _, d in found)
            digits = np.stack([c for c, _ in found], axis=1).tolist()
            codes = ["".join(f"{c:02x}" for c in row) for row in digits]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(codes, pa.string()), as_longs(error)], ["vec_id", "label", "code", "error"])


def fit(vectors: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> tuple[list[np.ndarray], int]:
    """The codebooks after ``rounds`` rounds, and the length to which vectors are filled up."""
    width = vectors.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    width = -(-width // parts) * parts
    least = vectors.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    if not least:
        return [], width
    seeds = _parts(pa.array([r.embedding for r in least], pa.list_(pa.float64())), width, parts, scale)
    books = [seeds[:, p] for p in range(parts)]
    for _ in range(rounds):
        each = vectors.select("embedding").mapInArrow(partial(_sums, books=books, width=width, scale=scale), "part int, entry int, place int, high string, middle long, low long, n long")
        limbs = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("middle", "low")]
        # The highest limb is 0 or -1 but for components beyond 1e36, and these are few enough to be listed by value.
        sums = each.groupBy("part", "entry", "place", "high").agg(*limbs, F.sum("n").alias("n"), F.count("*").alias("batches"))
        new = [b.astype(object) for b in books]
        total: dict[tuple[int, int, int], list[int]] = {}
        for r in sums.toLocalIterator():
            held = total.setdefault((r.part, r.entry, r.place), [0, 0])
            held[0] += int(r.high) * r.batches * LIMB * LIMB + int(r.middle) * LIMB + int(r.low)
            held[1] += r.n
        for (p, e, i), (s, n) in total.items():
            new[p][e, i] = s // n
        books = [b.astype(np.int64) if max(map(abs, b.ravel().tolist()), default=0) < 2**62 else b for b in new]
    return books, width


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def compress(table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row of ``table`` (vec_id, embedding, label) that takes part.

    A component x counts as floor(scale * x).  A part's codebook starts as that
    part of the rows with the ``entries`` least vec_ids; each round replaces
    each entry by the floors of the means of its parts' components, and leaves
    unused ones.  ``error`` is the squared distance of the vector from its
    code's entries, ``label_error`` its sum over all rows of the label, rows
    without label together.

    * Vectors that are null or hold null or non-finite components are dropped.
    * Rows of a repeated vec_id count separately; among the first entries they
      come in the order of their components.  A missing vec_id comes last.
    * Fewer rows than entries make smaller codebooks; an empty table gives no rows.
    * Shorter vectors, and a length that ``parts`` doesn't divide, are filled up with zeros.
    * An error that a long can't hold is null, and so is its label's sum.
    * Other columns are not looked at.
    """
    if scale & (scale - 1) or not 1 <= entries <= 256:
        raise ValueError("scale must be a power of two, and a code has two hex digits")
    vectors = finite_vectors(table, "label")
    label = f"label {vectors.schema['label'].dataType.simpleString()}"
    books, width = fit(vectors, parts, entries, rounds, scale)
    if not books:
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(digest([])).alias("codebooks_sha256")).limit(0)
    # Both are saved: the coded rows are read twice, and Spark then knows the labels' size and broadcasts it only if it is small.
    scratch = Scratch(table.sparkSession, "codes")
    coded = scratch.save(vectors.mapInArrow(partial(_coded, books=books, width=width, scale=scale), f"vec_id long, {label}, code string, error long"), "coded")
    lost = F.max(F.col("error").isNull())
    total = F.try_sum(F.col("error").cast("decimal(38,0)"))
    sums = scratch.save(coded.groupBy("label").agg(F.when(~lost, total.try_cast("long")).alias("label_error")), "labels").withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
