"""Quality rules with cross-document line frequency (operator 6), in DataFrame functions only.

A document first has to pass rules on itself (enough words, few repeated
5-word windows).  Then its lines are compared with those of its host: lines
are normalised (lower case, white space collapsed) and hashed, and a line that
occurs in more than ``max_docs`` different documents of the host, and in more
than ``max_docs_percent`` percent of them, is boilerplate and removed.  The
share keeps the verdict from depending on how many rows a host has; the number
is its floor on small hosts.  A document that loses more than half of its words
is depleted and rejected.

A host's documents are its different texts: copies of a text count once.  Near
copies are different texts, so a group of them that exceeds both limits in one
host loses the lines it shares, as pages of one template do.

Scale: one scan computes the rules and the line hashes into a narrow scratch
table; all shuffles of the counting carry only hashes.  A line shared by a
third of all documents is pre-aggregated before each shuffle or sits in a join
whose skewed side Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, free, text_or_empty

_GAP = "[ \t-\r]+"
SYMBOLS = "#*$%&|<>"
#: A large host's number of texts is joined in this many parts.
PARTS = 64


def _count_of(text, characters: str):
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _base(docs: DataFrame, window: int) -> DataFrame:
    """Adds the counts of a text on its own; needs a column ``body`` without nulls."""
    trimmed = docs.withColumn("trimmed", F.trim("body", F.lit(SPACES)))
    words = F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", _GAP))
    with_words = trimmed.withColumn("words", words).withColumn("n_words", F.size("words").cast("long"))
    w = F.col("words")
    starts = F.sequence(F.lit(0), F.size("words") - window)
    hashed = F.when(F.size("words") >= window, F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))).otherwise(F.array().cast("array<bigint>"))
    hashes = with_words.withColumn("windows", hashed)
    # Sorted (hash, place): equal windows are neighbours.  Most texts have none and skip this.
    placed = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    ordered = hashes.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed))
    o = F.col("ordered")
    again = F.filter(o, lambda x, k: (F.get(o, k - 1)["h"] == x["h"]) | (F.get(o, k + 1)["h"] == x["h"]))
    # get() gives null before the first and after the last place, so an "or" with one null stays null: not equal.
    repeated = ordered.withColumn("places", F.array_sort(F.transform(again, lambda x: x["i"])))
    p = F.col("places")
    covered = F.aggregate(F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(window)), F.lit(window))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return (
        repeated.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint")))
        .withColumn("word_chars", F.length(F.translate("body", SPACES, "")).cast("long"))
        .withColumn("n_symbols", _count_of(F.col("body"), SYMBOLS).cast("long"))
        .withColumn("n_dup_lines", (F.size("own_lines") - F.size(F.array_distinct("own_lines"))).cast("long"))
        .drop("trimmed", "words", "windows", "ordered", "places")
    )


def _hashed_line(line):
    even = F.lower(F.regexp_replace(F.trim(line, F.lit(SPACES)), _GAP, " "))
    return F.struct(F.xxhash64(even).alias("h"), (_count_of(even, " ") + 1).alias("n"))


def quality_rules(
    docs: DataFrame, host: str = "source", min_words: int = 10, max_repeat_percent: int = 20, window: int = 5, max_docs: int = 10, max_removed_percent: int = 50, clean: bool = False, max_docs_percent: int = 5
) -> DataFrame:
    """The counts and the verdict for every row of ``docs`` (doc_id, text, the host column).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_removed_words (in boilerplate lines),
    depleted and kept.  With ``clean``, returns instead the kept rows with all
    their columns, boilerplate lines cut out of ``text`` (and ``n_chars``, if
    there, counted again); texts without such lines stay as they are.

    A null text counts as empty; a text without words has base_failed.  A null
    host is a host of its own.  doc_id is only passed through, nulls and
    repeats included; equal rows get equal verdicts.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    source = F.coalesce(F.col(host).cast("string"), F.lit("\0")) if host in docs.columns else F.lit("")
    body = docs.select("doc_id", text_or_empty().alias("body"), source.alias("host"))
    keyed = body.select("doc_id", "body", "host", F.xxhash64("host", "body").alias("key_a"), F.hash("body", "host").alias("key_b"))
    lined = keyed.withColumn("own_lines", F.filter(F.split("body", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != ""))
    based = _base(lined.withColumn("lines", F.transform("own_lines", _hashed_line)), window)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = scratch.save(based.select("doc_id", "host", "key_a", "key_b", *counts, failed.alias("base_failed"), "lines"), "rows")

    line = F.xxhash64("host", "h").alias("line")
    held = rows.select("host", "key_a", "key_b", F.explode(F.array_distinct("lines.h")).alias("h")).select(line, F.xxhash64("host").alias("site"), "key_a", "key_b").distinct()
    lines = held.groupBy("line", "site").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_docs).withColumn("part", F.pmod("line", F.lit(PARTS)).cast("int"))
    sites = rows.select(F.xxhash64("host").alias("site"), "key_a", "key_b").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("of"))
    parts = sites.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    common = lines.join(parts, ["site", "part"]).where(100 * F.col("n") > max_docs_percent * F.col("of")).select("line")
    hit = held.join(common, "line").groupBy("key_a", "key_b").agg(F.collect_set("line").alias("common"))

    at = F.col("common")
    gone = F.aggregate(F.filter("lines", lambda x: F.array_contains(at, F.xxhash64("host", x["h"]))), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    judged = (
        rows.join(hit, ["key_a", "key_b"], "left")
        .withColumn("n_removed_words", F.when(at.isNull(), F.lit(0).cast("bigint")).otherwise(gone))
        .withColumn("depleted", 100 * F.col("n_removed_words") > max_removed_percent * F.col("n_words"))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )
    if not clean:
        return judged.select("doc_id", *counts, "base_failed", "n_removed_words", "depleted", "kept")

    # One verdict for a text of a host, however many rows have it; the names below clash with none of docs.
    text, site, a, b, found = free(docs.columns, "body", "host", "key_a", "key_b", "common")
    verdicts = judged.groupBy("key_a", "key_b").agg(F.first("kept").alias("kept"), F.first("common").alias(found)).where("kept").select(F.col("key_a").alias(a), F.col("key_b").alias(b), found)
    keyed = docs.withColumns({text: text_or_empty(), site: source}).withColumns({a: F.xxhash64(site, text), b: F.hash(text, site)})
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(found, F.xxhash64(site, _hashed_line(x)["h"]))), "\n")
    cut = keyed.join(verdicts, [a, b]).withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return cut.select(*docs.columns)
