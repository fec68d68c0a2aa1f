"""Source divergence audit: how far the sources of a language are apart in their use of words (operator 13).

Count vectors as a count vectoriser makes them for each language: its vocabulary
is every term in at least ``least`` of its documents, of any size.  A task makes
its documents' sparse vectors and adds them up by source at once, as a
summariser does; the vocabulary is cut from the sums afterwards, for which the
number of documents of a term is counted beside.  Neither the vocabulary nor a
vector goes through the driver or is broadcast: Spark ML's own ``CountVectorizer``
does both, and here the vocabulary has no bound.  (The tests hold the counts
against that class and ``Summarizer``.)

Shares are whole numbers out of 1e9.  For pairs of sources the vocabulary is cut
into slices by the terms' hash and the sources into blocks; a task gets the
terms of a slice that any source of two blocks uses, as rows of (source, term,
share), and adds up the pairs' divergence over them in numpy.  Terms that
neither block uses all have the same divergence for a pair, so they are counted
and multiplied at the end.  Pairs are made once for each slice, never for each
term.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices

#: Terms held by a task before it gives out its sums.
HELD = 1_000_000
#: Terms of a slice, and sources of a block, on average at most.
SLICE, BLOCK = 4_096, 256
WHOLE = 1_000_000_000

#: A-Z become a-z; what is neither an ASCII letter nor outside ASCII becomes a space.
_TERMS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256)).lower()


def terms(text: str) -> list[bytes]:
    """All terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` in order, A-Z in lower case, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split()


def _sums(batches):
    """(lang, source, term, n, docs) of the task's documents; one row without term for each group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def given():
        for (lang, source), (counts, documents) in groups.items():
            names = [None, *(t.decode("utf-8", "replace") for t in counts)]
            n = len(names)
            yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(n, np.int64))), pa.array([source]).take(pa.array(np.zeros(n, np.int64))), pa.array(names, pa.string()), pa.array([0, *counts.values()], pa.int64()), pa.array([0, *(documents[t] for t in counts)], pa.int64())], schema=schema)

    for batch in slices(batches):
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            counts, documents = groups.setdefault((lang, source), (Counter(), Counter()))
            found = terms(text)
            counts.update(found)
            documents.update(set(found))
        if sum(len(c) for c, _ in groups.values()) + len(groups) > HELD:
            yield from given()
            groups.clear()
    yield from given()


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1e9 * (n + 2) / (total + 2 * kept)), exactly; null where the language keeps no term."""
    above = (n.cast("decimal(20,0)") + 2) * F.lit(WHOLE).cast("decimal(10,0)")
    below = F.nullif(total.cast("decimal(20,0)") + 2 * kept.cast("decimal(20,0)"), F.lit(0))
    return F.call_function("div", above, below) + 1


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of positive shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _cell(table: pa.Table) -> pa.Table:
    """Sums over the terms of one slice for all pairs of a source of the left and one of the right block.

    Rows without term give the share of an unused term for each source.
    """
    schema = pa.schema([("lang", pa.string()), ("left", pa.string()), ("right", pa.string()), ("value", pa.int64()), ("terms", pa.int64())])
    bare = pc.is_null(table.column("term"))
    groups, used = table.filter(bare), table.filter(pc.invert(bare))
    sides = []
    all_terms = pc.unique(used.column("term"))
    column_of = pc.index_in(used.column("term"), all_terms).to_numpy(zero_copy_only=False) if used.num_rows else np.zeros(0, np.int64)
    for side in (0, 1):
        own = groups.filter(pc.equal(groups.column("side"), side))
        names = own.column("source").combine_chunks()
        shares = np.repeat(own.column("share").to_numpy()[:, None], len(all_terms), axis=1)
        here = pc.equal(used.column("side"), side).to_numpy(zero_copy_only=False).astype(bool)
        mine = used.filter(pa.array(here))
        if mine.num_rows:
            shares[pc.index_in(mine.column("source"), names).to_numpy(), column_of[here]] = mine.column("share").to_numpy()
        sides.append((names, shares))
    (left, p), (right, q) = sides
    one_block = len(right) == 0  # both sides are the same block, which is sent once
    if one_block:
        right, q = left, p
    out = []
    for i in range(len(left)):
        d = q - p[i]
        value = (d * d // (q + p[i])).sum(axis=1)
        other = np.arange(len(right)) > i if one_block else np.ones(len(right), dtype=bool)
        out.append((np.full(other.sum(), i), np.flatnonzero(other), value[other]))
    if not out:
        return schema.empty_table()
    a, b, value = (np.concatenate(x) for x in zip(*out, strict=True))
    lang = table.column("lang").slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(a), np.int64)))
    return pa.table([lang, left.take(pa.array(a)), right.take(pa.array(b)), pa.array(value, pa.int64()), pa.array(np.full(len(a), len(all_terms)), pa.int64())], schema=schema)


def _pairs(entries: DataFrame, sizes: DataFrame, terms_kept: int, blocks: int) -> DataFrame:
    """(lang, left, right, value, terms): each pair of sources once, summed over the terms that its blocks use."""
    parts = max(1, -(-terms_kept // SLICE))
    used = entries.select("lang", "source", "term", F.col("p").alias("share"), F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("slice"))
    bare = sizes.where("kept > 0").select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("unused").alias("share"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("slice"))
    own = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    dealt = used.union(bare).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = dealt.select("lang", "slice", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "source", "term", "share", (F.col("own") > F.col("other")).cast("int").alias("side"))
    summed = cells.groupBy("lang", "slice", "a", "b").applyInArrow(_cell, "lang string, left string, right string, value long, terms long")
    return summed.groupBy("lang", "left", "right").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))


def divergence(docs: DataFrame, least: int = 10, listed: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs in ``docs`` (text, lang, source).

    Part ``pair``: the language's other sources, by their divergence from this
    one over the whole vocabulary.  Part ``term``: the ``listed`` terms that the
    source uses more than its language does, by divergence from the language.
    Ranks start at 1; ties go to the item that comes first in UTF-8.

    * Null text, lang and source are read as ''; '' is a language and a source like any other.
    * Every row is a document, repeated doc_ids too.
    * A source without terms has all its language's pairs; a language that keeps no term has pairs of value 0; a source alone in its language has no pair.
    * An empty table gives no rows.  Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    narrow = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    sums = narrow.mapInArrow(_sums, "lang string, source string, term string, n long, docs long")
    counted = scratch.save(sums.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counted")
    vocabulary = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    vocabulary = scratch.save(vocabulary.select("lang", "term", "total"), "vocabulary")
    kept = scratch.save(counted.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "kept")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("of_lang"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("of_source"))
    sizes = counted.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["of_source", "kept", "of_lang"])
    sizes = scratch.save(sizes.withColumn("unused", _share(F.lit(0).cast("long"), F.col("of_source"), F.col("kept"))), "sizes")
    scratch.drop("counted")
    terms_kept = vocabulary.count()
    most = sizes.groupBy("lang").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]

    shared = kept.join(sizes, ["lang", "source"]).withColumns({"p": _share(F.col("n"), F.col("of_source"), F.col("kept")), "q": _share(F.col("total"), F.col("of_lang"), F.col("kept"))})
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    special = shared.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    special = special.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= listed)

    def unused(side: str) -> DataFrame:
        return sizes.select("lang", F.col("source").alias(side), F.col("unused").alias(f"of_{side}"), *(["kept"] if side == "left" else []))

    pairs = _pairs(shared, sizes, terms_kept, max(1, -(-most // BLOCK))).join(unused("left"), ["lang", "left"]).join(unused("right"), ["lang", "right"])
    pairs = pairs.withColumn("value", F.col("value") + (F.col("kept") - F.col("terms")) * _apart(F.col("of_left"), F.col("of_right")))
    both = pairs.select("lang", F.inline(F.array(F.struct(F.col("left").alias("source"), F.col("right").alias("item")), F.struct(F.col("right").alias("source"), F.col("left").alias("item")))), "value")
    empty = sizes.where("kept = 0").select("lang", "source")
    no_terms = empty.join(empty.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pair = both.unionByName(no_terms).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return pair.union(special).withColumn("rank", F.col("rank").cast("int"))
