"""Exact top-k inner products by MaxScore (operator 11).

Components are the terms, and a shard's column of a component is that term's
posting list, in the order of vec_id.  For a query, a block of postings bounds
what each term can add to a score.  Terms are ordered by that bound; the ones
with the least bounds, which together can't lift a candidate over the query's
k-th best score, are non-essential.  The essential postings of a block are
traversed for a whole block of queries by one product of matrices; candidates
whose sum could still win are competitive, and only for these are the other
terms probed, from the largest bound down, dropping a candidate as soon as it
can't win any more.  Postings are read in the order of vec_id, so of equal
scores the earlier one stays and a later one must be strictly better.

Scale: candidates and queries are dealt by a hash of the row into shards and
blocks of bounded size; each cell of both is one task's work in constant memory
and gives k rows for each query at most, which a window with a group limit
merges.  Cells grow with queries times candidates, as an exact search must;
nothing is broadcast or collected.

Sums are doubles where every sum is below 2**53, so exact, and Python integers
elsewhere.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import finite_vectors, matrix, scaled_floor

#: Rows of a shard of candidates and of a block of queries, at most on average.
SHARD, BLOCK = 32_768, 4_096
#: Components of a shard, at most on average; a wide table has smaller shards and blocks.
COMPONENTS = 2**22
#: Shards at least, while there are enough rows, so that a small table is no single task's work.
LEAST_SHARDS = 20
#: Postings of a list that are read at a time.
POSTINGS = 512
#: Non-essential terms may hold so much of the threshold (a fraction): a product is cheaper than a probe of many candidates.
NON_ESSENTIAL = 3, 10
#: Terms probed between two tests of what is still competitive.
PROBED = 8
#: Above the high limb of any sum of products of doubles; added to it, all of these have as many hex digits and sort as text.
_HIGHEST = 2**2400


def _best(query: np.ndarray, score: np.ndarray, place: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score falling, place rising) of each query's rows."""
    order = np.lexsort((place, -score, query))
    query, score, place = query[order], score[order], place[order]
    first = np.searchsorted(query, np.arange(n))
    kept = np.arange(len(query)) - first[query] < k
    return query[kept], score[kept], place[kept]


def _threshold(query: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """Each query's k-th score so far; minus infinity before there are k."""
    out = np.full(n, -np.inf, dtype=score.dtype if score.dtype == object else np.float64)
    count = np.bincount(query, minlength=n)
    full = count >= k
    out[full] = score[(np.cumsum(count) - 1)[full]]
    return out


def search(queries: np.ndarray, shard: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, place in the shard) of the k best for each query, by query, then rank.

    ``shard`` is in tie order; ``own`` is the place that a query has in it, or -1.
    """
    n, width = queries.shape
    top = max((int(abs(x).max()) if x.size else 0) for x in (queries, shard))
    kind = np.float64 if top * top * max(width, 1) < 2**53 else object
    queries, shard = queries.astype(kind), shard.astype(kind)
    query, score, place = np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64)
    for start in range(0, len(shard), POSTINGS):
        block = shard[start : start + POSTINGS]
        bar = _threshold(query, score, n, k)
        # What each term can add: its bound over the block's postings; 0 stands for a candidate without the term.
        bound = np.maximum(np.maximum(queries * block.max(axis=0), queries * block.min(axis=0)), 0) if width else queries
        order = np.argsort(bound, axis=1, kind="stable")
        rising = np.cumsum(np.take_along_axis(bound, order, 1), axis=1)
        started = bar > -np.inf
        share = np.where(started, bar, 0) * NON_ESSENTIAL[0]
        spare = np.where(share > 0, (rising * NON_ESSENTIAL[1] <= share[:, None]).sum(axis=1), 0)
        ranks = np.empty_like(order)
        np.put_along_axis(ranks, order, np.arange(width)[None, :].repeat(n, 0), 1)
        essential = np.where(ranks >= spare[:, None], queries, 0)
        sums = essential @ block.T
        rest = np.where(spare > 0, rising[np.arange(n), spare - 1], 0) if width else np.zeros(n, kind)
        fresh = np.flatnonzero(~started)
        hit = sums + rest[:, None] > bar[:, None]
        inside = np.flatnonzero((own >= start) & (own < start + len(block)))
        hit[inside, own[inside] - start] = False
        if len(fresh) and kind is np.float64 and len(block) > k + 1:
            # No threshold yet: all sums are whole, so take each query's k best of the block at once.
            part = np.where(hit[fresh], sums[fresh], -np.inf)
            cut = -np.partition(-part, k - 1, axis=1)[:, k - 1]
            hit[fresh] &= part >= cut[:, None]
        q, c = np.nonzero(hit)
        found, left = sums[q, c], rest[q]
        depth = spare[q].copy()
        while (open_ := depth > 0).any():
            # Probe the next terms from the largest bound down.
            at = np.flatnonzero(open_)
            for step in range(PROBED):
                at = at[depth[at] > 0]
                if not len(at):
                    break
                term = order[q[at], depth[at] - 1]
                found[at] += queries[q[at], term] * block[c[at], term]
                left[at] = left[at] - bound[q[at], term]
                depth[at] -= 1
            alive = found + np.where(depth > 0, left, 0) > bar[q]
            q, c, found, left, depth = q[alive], c[alive], found[alive], left[alive], depth[alive]
        if len(q):
            query, score, place = _best(np.concatenate([query, q]), np.concatenate([score, found]), np.concatenate([place, c + start]), n, k)
    return query, score, place


def _cell(key, asked: pa.Table, held: pa.Table, k: int, scale: int) -> pa.Table:
    """One block of queries against one shard of candidates."""
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("high", pa.int64()), ("beyond", pa.string()), ("low", pa.int64())])
    if not asked.num_rows or not held.num_rows:
        return schema.empty_table()
    held = held.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    width = max(pa.compute.max(pa.compute.list_value_length(t.column("embedding"))).as_py() for t in (asked, held))
    values = [scaled_floor(matrix(t.column("embedding").combine_chunks(), width), scale) for t in (asked, held)]
    rows, mine = held.column("row").to_numpy(), asked.column("row").to_numpy()
    by_row = np.argsort(rows)
    spot = np.minimum(np.searchsorted(rows, mine, sorter=by_row), len(rows) - 1)
    own = np.where(rows[by_row[spot]] == mine, by_row[spot], -1)
    query, score, place = search(values[0], values[1], own, k)
    if score.dtype == object:
        limbs = [divmod(int(s), 2**62) for s in score]
        high, low = [max(-(2**63), min(2**63 - 1, h)) for h, _ in limbs], [rest for _, rest in limbs]
        beyond = ["" if h == c else f"{h + _HIGHEST:x}" for (h, _), c in zip(limbs, high, strict=True)]
    else:
        whole = score.astype(np.int64)
        high, low, beyond = whole >> 62, whole & (2**62 - 1), [""] * len(whole)
    return pa.table([pa.array(mine[query]), asked.column("vec_id").take(pa.array(query)), held.column("vec_id").take(pa.array(place)), pa.array(high, pa.int64()), pa.array(beyond, pa.string()), pa.array(low, pa.int64())], schema=schema)


def top_k(table: DataFrame, k: int = 20, every: int = 20, scale: int = 64, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row whose vec_id is divisible by ``every``.

    A component x counts as floor(scale * x); the score is the inner product.
    Candidates are all rows but the query's own; ties go to the smaller vec_id.

    * Vectors that are null or hold null or non-finite components take no part.
    * A row without vec_id asks nothing and is found as the last of equals.
    * Rows of a repeated vec_id are separate: each asks, and finds the others.
    * A shorter vector counts as filled up with zeros; an empty one scores 0.
    * A score that a long can't hold is ranked rightly and given as null.
    * An empty table gives no rows.  Other columns are not looked at.
    """
    if scale & (scale - 1):
        raise ValueError("scale must be a power of two")
    scratch = Scratch(table.sparkSession, "topk")
    # Saved once: the row numbers must stay the same in every read.
    vectors = scratch.save(finite_vectors(table).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asks = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    n, asked, width = vectors.agg(F.count("*"), F.count_if(asks), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    shard, block = (max(1, min(rows, COMPONENTS // max(width, 1))) for rows in (shard, block))
    shards = max(min(LEAST_SHARDS, -(-n // POSTINGS)), -(-n // shard), 1)
    blocks = max(-(-asked // block), 1)

    def dealt(name: str, parts: int):
        return F.pmod(F.xxhash64("row", F.lit(name)), F.lit(parts)).cast("int")

    queries = vectors.where(asks).withColumn("block", dealt("block", blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    candidates = vectors.withColumn("shard", dealt("shard", shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = (
        queries.groupBy("block", "shard")
        .cogroup(candidates.groupBy("block", "shard"))
        .applyInArrow(partial(_cell, k=k, scale=scale), "query_row long, query_id long, vec_id long, high long, beyond string, low long")
    )
    best = Window.partitionBy("query_row").orderBy(F.desc("high"), F.desc("beyond"), F.desc("low"), F.asc_nulls_last("vec_id"))
    score = F.when(F.col("high").between(-2, 1), F.shiftleft("high", 62).bitwiseOR(F.col("low")))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))
