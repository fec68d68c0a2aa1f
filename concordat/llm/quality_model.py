"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 8).

The statistics are computed by DataFrame functions in one scan.  Trees are
grown on the driver from a bounded sample of labelled rows: features are cut
into at most 64 bins at quantiles, each split is the best one over the bins'
sums of gradients and hessians, and leaves are Newton steps on the logistic
loss.  All trees are flattened into five arrays; a batch of rows walks through
all of them by numpy indexing, one step for each level.

Scale: only the sample (``sample_rows`` rows of numbers) comes to the driver;
scoring is one scan without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, text_or_empty

STATISTICS = ["words", "characters", "word_length", "distinct_words", "symbols", "digits", "capitals", "exclamations", "bars", "stops", "lines", "line_words", "repeated_lines", "closed_lines", "letters", "accented"]


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, the columns ``STATISTICS``), all of them doubles and never null."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("b"))
    trimmed = base.withColumn("t", F.trim("b", F.lit(SPACES)))
    split = trimmed.withColumns(
        {
            "w": F.when(F.col("t") == "", F.array().cast("array<string>")).otherwise(F.split("t", "[ \t-\r]+")),
            "l": F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != ""),
        }
    )
    n = F.greatest(F.size("w"), F.lit(1)).cast("double")
    c = F.greatest(F.length("b"), F.lit(1)).cast("double")
    k = F.greatest(F.size("l"), F.lit(1)).cast("double")

    def count(chars):
        return (F.length("b") - F.length(F.translate("b", chars, ""))).cast("double")

    letters = F.length(F.regexp_replace("b", r"[^\p{L}]+", ""))
    values = {
        "words": F.log1p(F.size("w").cast("double")),
        "characters": F.log1p(F.length("b").cast("double")),
        "word_length": F.length(F.translate("b", SPACES, "")) / n,
        "distinct_words": F.size(F.array_distinct("w")) / n,
        "symbols": count("#*$%&|<>") / c,
        "digits": count("0123456789") / c,
        "capitals": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / c,
        "exclamations": count("!?") / n,
        "bars": count("|{}[]=_~^\\") / n,
        "stops": count(".,;:") / n,
        "lines": F.log1p(F.size("l").cast("double")),
        "line_words": F.size("w") / k,
        "repeated_lines": (F.size("l") - F.size(F.array_distinct("l"))) / k,
        "closed_lines": F.size(F.filter("l", lambda x: F.rtrim(x).rlike("[.!?\")]$"))) / k,
        "letters": letters / c,
        "accented": (F.octet_length("b") - F.length("b")) / c,
    }
    return split.select("doc_id", *[values[s].cast("double").alias(s) for s in STATISTICS])


@dataclass
class Forest:
    """Flattened trees: at node i, go to left[i] if x[feature[i]] <= limit[i], else to right[i]; leaves point to themselves."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        total = np.full(len(x), self.start)
        if len(self.roots) and len(x):
            rows = np.arange(len(x))[:, None]
            at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
            total = total + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least_rows: int = 8) -> Forest:
    """Boosted trees for labels ``y`` of 0 and 1; with one label only, or no rows, a constant."""
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Forest(*[np.zeros(0, t) for t in (int, float, int, int, float, int)], depth, start)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    offset = np.arange(x.shape[1]) * bins
    node: dict[str, list] = {k: [] for k in ("feature", "limit", "left", "right", "value")}
    roots, raw = [], np.full(n, start)

    def add(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> int:
        here = len(node["value"])
        for k, v in (("feature", 0), ("limit", 0.0), ("left", here), ("right", here), ("value", 0.0)):
            node[k].append(v)
        sum_g, sum_h = g[rows].sum(), h[rows].sum()
        best = None
        if level < depth and len(rows) >= 2 * least_rows:
            flat = (binned[rows] + offset).ravel()
            m = x.shape[1]
            hist = [np.bincount(flat, np.repeat(v[rows], m) if v is not None else None, minlength=m * bins).reshape(m, bins).cumsum(axis=1) for v in (g, h, None)]
            lg, lh, ln = hist
            gain = lg**2 / (lh + ridge) + (sum_g - lg) ** 2 / (sum_h - lh + ridge) - sum_g**2 / (sum_h + ridge)
            gain[(ln < least_rows) | (len(rows) - ln < least_rows)] = -1
            j, b = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[j, b] > 1e-6 and b < len(cuts[j]):
                best = int(j), int(b)
        if best is None:
            node["value"][here] = rate * -sum_g / (sum_h + ridge)
            raw[rows] += node["value"][here]
            return here
        j, b = best
        goes = binned[rows, j] <= b
        node["feature"][here], node["limit"][here] = j, float(cuts[j][b])
        node["left"][here] = add(rows[goes], g, h, level + 1)
        node["right"][here] = add(rows[~goes], g, h, level + 1)
        return here

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        roots.append(add(np.arange(n), p - y, p * (1 - p), 0))
    arrays = [np.array(node["feature"]), np.array(node["limit"]), np.array(node["left"]), np.array(node["right"]), np.array(node["value"])]
    return Forest(*arrays, np.array(roots), depth, start)


def held_out(part: int, of: int):
    """crc32 of the doc_id as text, modulo ``of``, is ``part``; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % of == part, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, out_part: int = 2, of: int = 4, sample_rows: int = 20_000, **options) -> Forest:
    """Trees from labelled rows that aren't held out.

    ``labels`` (doc_id, quality) may name up to ``sample_rows`` documents that
    are used: those with the least hashes of their doc_id, whatever the size of
    the tables.  Labels other than 0 and 1 are left out; a document with both
    labels counts with each.  A doc_id that occurs again with another text
    counts once, by its least statistics.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~held_out(out_part, of)).distinct()
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    # At most sample_rows rows of two integers: a proven bound.
    found = statistics(docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi"))
    one = found.groupBy("doc_id").agg(F.min(F.struct(*STATISTICS)).alias("least")).select("doc_id", "least.*")
    table = one.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "quality").toArrow()
    x = np.stack([np.asarray(table.column(s)) for s in STATISTICS], axis=1) if table.num_rows else np.zeros((0, len(STATISTICS)))
    return grow(x, np.asarray(table.column("quality"), dtype=float), **options)


def classify(docs: DataFrame, forest: Forest, cut: float = 0.7, out_part: int = 2, of: int = 4) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Only the text enters the score; null and empty texts are scored by their
    statistics, which are zeros.  A null doc_id is passed through and counts as
    held out; repeated rows get equal scores; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        trees = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = np.stack([np.asarray(part.column(s)) for s in STATISTICS], axis=1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(trees.scores(x))], ["doc_id", "score"])

    scored = statistics(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(out_part, of).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
