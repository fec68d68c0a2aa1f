"""MinHash near-duplicates by a multi-index Hamming join (operator 1).

Every text becomes the set of its distinct word shingles and a signature of
``chunks * chunk_len`` 16-bit MinHash symbols.  Two sets of similarity J agree
in a symbol with probability J (and 2**-16 by chance), so the number of unequal
symbols, the Hamming distance, estimates 1 - J.

The join is by pigeonhole.  If two signatures differ in at most
``chunks * (errors + 1) - 1`` symbols, some chunk holds at most ``errors``
unequal ones.  Each chunk is therefore indexed once for every choice of the
``errors`` symbols left out: all pairs within that distance are sure to meet
under an equal key.  Pairs beyond it that meet all the same are checked too.
With 12 chunks of 6 and one error, a pair of similarity 0.8 is missed with
probability 3e-6, one of 0.9 with 3e-12.

Every link is confirmed on the full shingle sets.

Scale.  Equal sets are collapsed before anything is joined, so thousands of
copies count once.  In a key's bucket all members are first held against the
member of the least id; the confirmed links are contracted to components, and
only pairs between different components of a bucket are looked at afterwards,
in tasks that hold one cell of bounded size at a time and give out only links
that join components, never candidate pairs.
Large buckets of many components are split by a second pigeonhole key that
keeps the guarantee, and any bucket that is still large is dealt into a grid of
cells; no bucket is ever collected into one task and none is cut short.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free, mix, shingle_hashes, slices, text_or_empty, word_hashes

CHUNKS, CHUNK_LEN, ERRORS = 12, 6, 1
#: A task holds the members of one cell; buckets of more members are split into several.
BUCKET = 1500
#: The same for the shingles of its members.
SHINGLES = 1_500_000
#: Rows with their shingle sets that a task takes up at once; Spark bounds the bytes of each Arrow batch.
SETS_AT_ONCE = 1024

_rng = np.random.default_rng(7)
_MULTIPLIERS = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(shingles: np.ndarray, symbols: int) -> np.ndarray:
    """16-bit MinHash symbols of a non-empty array of shingle hashes."""
    low = np.full(symbols, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1024):
            block = np.multiply.outer(_MULTIPLIERS[:symbols], shingles[at : at + 1024])
            np.minimum(low, block.min(axis=1), out=low)
    return (mix(low) >> np.uint64(48)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray, chunks: int, chunk_len: int, errors: int) -> np.ndarray:
    """Keys of every chunk for every choice of left-out symbols: an array (rows, chunks, choices)."""
    kept = list(combinations(range(chunk_len), chunk_len - errors))
    parts = signatures.reshape(len(signatures), chunks, chunk_len).astype(np.uint64)
    out = np.empty((len(signatures), chunks, len(kept)), np.uint64)
    salt = np.arange(chunks, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for c, places in enumerate(kept):
            key = np.broadcast_to(mix(salt * np.uint64(len(kept)) + np.uint64(c + 1)), out.shape[:2])
            for p in places:
                key = mix(key ^ parts[:, :, p]) + np.uint64(0x9E3779B97F4A7C15)
            out[:, :, c] = key
    return out


def _signatures(width: int, symbols: int, with_set: bool):
    def run(batches):
        for batch in slices(batches):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            sizes, first, second, signs, sets = [], [], [], [], []
            for text in texts:
                own = np.unique(shingle_hashes(word_hashes(text or ""), width))
                sizes.append(len(own))
                raw = own.tobytes()
                if with_set:
                    sets.append(raw)
                    continue
                whole = xxhash.xxh3_128_intdigest(raw)
                first.append((whole >> 64) - 2**63)
                second.append((whole & (2**64 - 1)) - 2**63)
                signs.append(minhash(own, symbols).tobytes() if len(own) else None)
            if with_set:
                yield pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.binary())], ["id", "shingles"])
            else:
                columns = [ids, pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(signs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return run


def _keys(chunks: int, chunk_len: int, errors: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                signs = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(part.num_rows, -1)
                keys = chunk_keys(signs, chunks, chunk_len, errors).reshape(part.num_rows, -1)
                repeat = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
                slots = np.tile(np.arange(keys.shape[1], dtype=np.int16), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), part.column("id").take(repeat), part.column("n_shingles").cast(pa.int32()).take(repeat), pa.array(slots)], ["key", "id", "size", "slot"])

    return run


def _second_keys(chunks: int, chunk_len: int, errors: int):
    """For rows of a large bucket: the bucket's key together with keys of the row's other chunks.

    A pair within ``chunks * (errors + 1) - 1`` symbols that shares the bucket
    has at most that many unequal symbols in the other ``chunks - 1`` chunks,
    so one of them holds at most ``errors + 1``: with one symbol more left out
    of each key no such pair is lost.  The bucket's own chunk, which ``slot``
    names, would leave the bucket as it is and is skipped.
    """
    choices = len(list(combinations(range(chunk_len), errors)))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                signs = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(part.num_rows, -1)
                keys = chunk_keys(signs, chunks, chunk_len, errors + 1)
                own = np.asarray(part.column("slot")) // choices
                rows, at_chunk = np.nonzero(np.arange(chunks)[None, :] != own[:, None])
                keys = mix(keys[rows, at_chunk] ^ mix(np.asarray(part.column("key")).view(np.uint64)[rows])[:, None])
                repeat = pa.array(np.repeat(rows, keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *[part.column(n).take(repeat) for n in ("id", "comp", "size")], pa.array(np.full(len(repeat), -1, np.int16))], ["key", "id", "comp", "size", "slot"])

    return run


class _Cells:
    """What is done within cells of members, which come sorted by cell.

    A pair is taken up if its members are of different components, their set
    sizes and signatures allow a link, and the cell is the first of all cells
    in which they meet: that of their first chunk with few enough unequal
    symbols, and there of the first choice of left-out symbols that fits.  So
    no pair is looked at twice.  (Cells of second keys, slot -1, take all.)
    """

    def __init__(self, most: int, percent: int, chunks: int, chunk_len: int, errors: int):
        self.most, self.percent, self.chunks, self.chunk_len, self.errors = most, percent, chunks, chunk_len, errors
        self.kept = list(combinations(range(chunk_len), chunk_len - errors))

    def _allowed(self, x, y, comps, sizes, slots, signs):
        ok = (comps[x] != comps[y]) & (100 * np.minimum(sizes[x], sizes[y]) >= self.percent * np.maximum(sizes[x], sizes[y]))
        x, y = x[ok], y[ok]
        out = [np.zeros((0, 2), np.int64)]
        for at in range(0, len(x), 50_000):
            a, b = x[at : at + 50_000], y[at : at + 50_000]
            unequal = signs[a] != signs[b]
            near = unequal.sum(axis=1) <= self.most
            a, b, unequal = a[near], b[near], unequal[near].reshape(-1, self.chunks, self.chunk_len)
            first = (unequal.sum(axis=2) <= self.errors).argmax(axis=1)
            chunk = unequal[np.arange(len(a)), first]
            fits = np.stack([~chunk[:, list(k)].any(axis=1) for k in self.kept], axis=1)
            own = (slots[a] < 0) | (first * len(self.kept) + fits.argmax(axis=1) == slots[a])
            out.append(np.stack([a[own], b[own]], axis=1))
        return np.concatenate(out)

    def _pairs(self, table):
        """(first row of a cell, its pairs of rows) for all cells of the table that have pairs."""
        key, row, col, own, comps, sizes, slots = (np.asarray(table.column(n)) for n in ("key", "row", "col", "own", "comp", "size", "slot"))
        signs = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(key), -1)
        data = (comps, sizes, slots, signs)
        starts = np.concatenate([[0], np.flatnonzero((np.diff(key) != 0) | (np.diff(row) != 0) | (np.diff(col) != 0)) + 1])
        lengths = np.diff(np.concatenate([starts, [len(key)]]))
        for n in np.unique(lengths):
            here = starts[lengths == n]
            if n > 64 or (row[here] != col[here]).any():
                for s in here:
                    yield from self._large(np.arange(s, s + n), own, row[s] != col[s], data)
            elif n > 1:
                # Small cells of one size are handled together.
                i, j = np.triu_indices(int(n), 1)
                step = max(1, 500_000 // len(i))
                for at in range(0, len(here), step):
                    some = here[at : at + step]
                    yield self._allowed((some[:, None] + i).ravel(), (some[:, None] + j).ravel(), *data)

    def _large(self, rows, own, cross, data):
        # Rows outside the largest component against all: every wanted pair has such a row.
        _, inverse, counts = np.unique(data[0][rows], return_inverse=True, return_counts=True)
        outside = inverse != counts.argmax()
        rank = np.where(outside, np.arange(len(rows)), -1)
        left = np.flatnonzero(outside)
        step = max(1, 1_000_000 // len(rows))
        for at in range(0, len(left), step):
            some = left[at : at + step]
            x, y = np.repeat(some, len(rows)), np.tile(np.arange(len(rows)), len(some))
            once = rank[y] < x
            if cross:
                once &= own[rows[x]] != own[rows[y]]
            yield self._allowed(rows[x[once]], rows[y[once]], *data)

    def members_with_pairs(self, table):
        """The rows of members that have a pair in their cell."""
        used = np.zeros(table.num_rows, bool)
        for pairs in self._pairs(table):
            used[pairs.ravel()] = True
        return table.select(["key", "row", "col", "own", "id", "comp", "size", "slot"]).filter(pa.array(used)).combine_chunks().to_batches()

    def links(self, table):
        """Confirmed links (a, b) that join components: a forest of each cell's links."""
        ids, comps = np.asarray(table.column("id")), np.asarray(table.column("comp"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        least: dict[int, int] = {}

        def find(c):
            while least.get(c, c) != c:
                c = least[c]
            return c

        out = []
        for pairs in self._pairs(table):
            for at in range(0, len(pairs), 20_000):
                for x, y in self._confirmed(pairs[at : at + 20_000], sets):
                    a, b = find(comps[x]), find(comps[y])
                    if a != b:
                        least[max(a, b)] = min(a, b)
                        out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        a, b = zip(*out, strict=True) if out else ((), ())
        return [pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])]

    def _confirmed(self, pairs, sets):
        """The pairs whose full sets are similar enough."""
        if not len(pairs):
            return pairs
        rows, local = np.unique(pairs, return_inverse=True)
        local = local.reshape(-1, 2)
        sizes = np.array([len(sets[r]) for r in rows])
        values, inverse, counts = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
        place = np.cumsum(counts > 1) - 1  # only shingles of several sets can be shared
        width = int(place[-1]) + 1
        if len(pairs) > 100 and len(rows) * width <= 400_000_000:
            bits = np.zeros((len(rows), (width + 63) // 64), np.uint64)
            owner = np.repeat(np.arange(len(rows)), sizes)
            many = counts[inverse] > 1
            at = place[inverse[many]]
            np.bitwise_or.at(bits, (owner[many], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
            step = max(1, 4_000_000 // max(1, bits.shape[1]))
            both = np.concatenate([np.bitwise_count(bits[local[i : i + step, 0]] & bits[local[i : i + step, 1]]).sum(axis=1, dtype=np.int64) for i in range(0, len(local), step)])
        else:
            both = np.array([len(sets[x]) + len(sets[y]) - len(np.union1d(sets[x], sets[y])) for x, y in pairs])
        union = sizes[local[:, 0]] + sizes[local[:, 1]] - both
        return pairs[100 * both >= self.percent * union]

    def run(self, work, rows_at_once: int):
        """A function over Arrow batches that hands whole cells to ``work``."""

        def over(batches):
            held: list[pa.RecordBatch] = []
            rows = 0
            for batch in batches:
                for at in range(0, batch.num_rows, rows_at_once):
                    part = batch.slice(at, rows_at_once)
                    if held:
                        part = pa.Table.from_batches([*held[-1:], part]).combine_chunks().to_batches()[0]
                        rows -= held.pop().num_rows
                    k = np.stack([np.asarray(part.column(n)) for n in ("key", "row", "col")], axis=1)
                    turns = np.flatnonzero((np.diff(k, axis=0) != 0).any(axis=1)) + 1
                    cut = int(turns[-1]) if len(turns) else 0
                    if cut:
                        held.append(part.slice(0, cut))
                        yield from work(pa.Table.from_batches(held))
                        held, rows = [], 0
                    held.append(part.slice(cut))
                    rows += part.num_rows - cut
            if held:
                yield from work(pa.Table.from_batches(held))

        return over


def _distance():
    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="int32")
        x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1) for s in (a, b))
        return pd.Series((x != y).sum(axis=1).astype("int32"))

    return distance


def _similar(percent: int):
    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype="bool")

    return similar


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, comp): the least id that each end of the edges (a, b) can reach.

    Rounds of taking the least label of all neighbours and then the label of
    the label; each round is saved, nothing but a count comes to the driver.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        seen = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        lower = labels.join(seen, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        new = scratch.save(lower.join(up, "comp").select("id", F.least("comp", "further").alias("comp"), (F.col("old") != F.least("comp", "further")).alias("moved")), f"{name}-{turn}")
        moved = new.where("moved").limit(1).count()
        scratch.drop(f"{name}-{turn - 1}")
        labels = new.select("id", "comp")
        if not moved:
            scratch.drop(f"{name}-edges")
            return labels


def _grid(members: DataFrame) -> DataFrame:
    """Members as rows of cells (key, row, col) of bounded numbers of members and shingles; any two members of a bucket meet in exactly one cell."""
    parts = F.greatest(F.ceil(F.col("n") / BUCKET), F.ceil(F.col("shingles_held") / SHINGLES), F.lit(1)).cast("int")
    dealt = members.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("key", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"), "own", "id", "comp", "size", "slot")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows (key, id, comp) of buckets with several components, with the bucket's size and its number of pairs across components."""
    each = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    held = each.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("square"), F.sum("s").alias("shingles_held")).where("comps > 1")
    return rows.join(held.select("key", "n", "shingles_held", ((F.col("n") * F.col("n") - F.col("square")) / 2).alias("across")), "key")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, chunks: int = CHUNKS, chunk_len: int = CHUNK_LEN, errors: int = ERRORS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents are linked if ``100 * shared >= percent * all`` of their distinct
    ``width``-word shingles; ``component_id`` is the least doc_id that a
    document reaches by links, and ``kept`` marks that document.

    A null or empty text, or one of white space, has an empty set and links
    with nothing.  A row without doc_id cannot be named in a component: its
    component_id is null and it is kept.  Repeated rows each get their row.
    Rows that repeat a doc_id with another text count as one document that
    has the links of all of them.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    symbols = chunks * chunk_len
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    signed = scratch.save(narrow.mapInArrow(_signatures(width, symbols, False), "doc_id long, n_shingles long, set_a long, set_b long, signature binary"), "signatures")

    texts = signed.where("doc_id is not null and n_shingles > 0")
    distinct = scratch.save(texts.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "distinct")
    keys = distinct.select("id", "n_shingles", "signature").mapInArrow(_keys(chunks, chunk_len, errors), "key long, id long, size int, slot short")
    hubs = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub")).where("n > 1")
    members = scratch.save(keys.join(hubs, "key"), "members")

    wanted = members.select("id").distinct()
    sets = scratch.save(narrow.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(_signatures(width, symbols, True), "id long, shingles binary"), "sets")
    signs = distinct.select("id", "signature")
    confirmed, distance = _similar(percent), _distance()

    def links(near: DataFrame, name: str) -> DataFrame:
        a, b = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
        return scratch.save(near.join(a, "a").join(b, "b").where(confirmed("set_a", "set_b")).select("a", "b"), name)

    # A pair of the asked similarity is farther apart with probability 2e-6 or less.
    p = 1 - percent / 100
    most = int(symbols * p + 5.2 * (symbols * p * (1 - p)) ** 0.5)
    pairs = members.where("hub < id").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    a, b = (signs.select(F.col("id").alias(x), F.col("signature").alias(f"sign_{x}")) for x in "ab")
    star = links(pairs.join(a, "a").join(b, "b").where(distance("sign_a", "sign_b") <= most).select("a", "b"), "star")
    first = components(star, scratch, "first")

    labelled = members.select("key", "id", "size", "slot").join(first, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"), "size", "slot")
    mixed = scratch.save(_mixed(scratch.save(labelled, "labelled")), "mixed")
    scratch.drop("members", "labelled")
    crowded = (F.col("n") > BUCKET) & (F.col("across") > 4 * BUCKET * BUCKET)
    cells = _grid(mixed.where(~crowded))
    if mixed.where(crowded).limit(1).count():
        again = mixed.where(crowded).join(signs, "id").select("key", "id", "comp", "size", "slot", "signature").mapInArrow(_second_keys(chunks, chunk_len, errors), "key long, id long, comp long, size int, slot short")
        cells = cells.union(_grid(_mixed(scratch.save(again, "again"))))
    cell, work = ["key", "row", "col"], _Cells(most, percent, chunks, chunk_len, errors)
    member = "key long, row int, col int, own int, id long, comp long, size int, slot short"
    dealt = cells.join(signs, "id").repartition(*cell).sortWithinPartitions(*cell)
    used = scratch.save(dealt.select(*cells.columns, "signature").mapInArrow(work.run(work.members_with_pairs, 20_000), member), "used")
    with_sets = used.join(signs, "id").join(sets, "id").repartition(*cell).sortWithinPartitions(*cell)
    more = scratch.save(with_sets.select(*used.columns, "signature", "shingles").mapInArrow(work.run(work.links, SETS_AT_ONCE), "a long, b long").distinct(), "more")
    # A doc_id with several texts is one document: it ties their sets together.
    several = texts.select("doc_id", "set_a", "set_b").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    tied = texts.join(several, "doc_id").select("doc_id", "set_a", "set_b").distinct().join(distinct.select("set_a", "set_b", "id"), ["set_a", "set_b"]).where("id != doc_id")
    more = scratch.save(more.union(tied.select(F.col("id").alias("a"), F.col("doc_id").alias("b"))), "all")
    final = components(star.union(more), scratch, "final") if more.limit(1).count() else first

    reps = distinct.join(final, "id", "left").select("set_a", "set_b", F.coalesce("comp", "id").alias("comp"))
    joined = signed.drop("signature").join(reps, ["set_a", "set_b"], "left")
    found = joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that of the least doc_id.

    Rows without doc_id stay.  Of rows that repeat a kept doc_id one stays, the
    one with the least text.
    """
    (key,) = free(docs.columns, "kept_id")
    kept = near_duplicates(docs, **options).where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.count(F.lit(1)).alias("n"))
    kept = Scratch(docs.sparkSession, "kept").save(kept, "ids")

    def named(ids: DataFrame) -> DataFrame:
        return docs.join(ids.select(key), docs["doc_id"].cast("long") == ids[key], "left_semi")

    # Whole rows are only grouped where a doc_id occurs again.
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce("text", F.lit("")))
    again = named(kept.where("n > 1")).groupBy(F.col("doc_id").cast("long").alias(key)).agg(row.alias("one")).select("one.*")
    return docs.where("doc_id is null").unionByName(named(kept.where("n = 1"))).unionByName(again)
