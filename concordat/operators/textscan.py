"""Numbers, regions, literals and tables in document text, as rows with offsets.

Offsets are 0-based code points, ends are exclusive.  Tokens are cut out by
one pattern: the gaps between matches and the matches themselves add up to the
text, so running sums of their lengths are the offsets; no Python is involved.

Tables that grow together are joined by merge, which is a hint: Spark guesses a
size from compressed files, and what is made of a few packed numbers can be many
times that, too much for a broadcast through the driver.
"""

from __future__ import annotations

import re
import uuid
from functools import lru_cache, partial
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from concordat.functions.lexeme import NATIVE_TOKEN, TOKEN, sha256
from concordat.operators import intervals, scans


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements that a running sum collects before it starts a new part; appending to an array copies it.
PART = 512


def _sums_before(sizes: Column) -> Column:
    """For each element of an array of integers the sum of those before it; in parts, so that long arrays don't cost their square."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def run(part):
        return F.aggregate(part, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))

    def body(all_):
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / PART).cast("int")), lambda k: run(F.slice(all_, k * PART + 1, F.lit(PART))))
        return _let(cut, lambda parts: F.flatten(F.zip_with(parts, run(F.transform(parts, lambda p: p["at"]))["out"], lambda p, o: F.transform(p["out"], lambda x: x + o))))

    return _let(sizes, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(body(v)))


def _spans(text: Column, pattern: Column) -> Column:
    """array<struct<start,end,text>> of all matches."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), lambda x: x["hit"].isNotNull())

    def placed(x, before):
        begin = before + x["gap"]
        return F.struct(begin.alias("start"), (begin + F.length(x["hit"])).alias("end"), x["hit"].alias("text"))

    return _let(zipped, lambda z: F.zip_with(z, _sums_before(F.transform(z, lambda x: x["gap"] + F.length(x["hit"]))), placed))


#: Matches of a text that are placed without higher-order functions, which Spark interprets.
FEW = 8


def _cut_out(rows: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, text, ord, s) of the ``_spans`` of (doc_id, text) by a pattern whose matches aren't empty.

    One pass of the pattern puts a character at both sides of every match, at
    which the text is split: Spark compiles a longer pattern to split at anew
    for each row.  A text that holds that character itself goes the way of
    those with many matches.
    """
    text, mark = F.col("text"), "\x01"
    met = rows.select("doc_id", "text", F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{mark}$0{mark}")), mark, -1).alias("_parts"))
    places, at = [], F.lit(0)
    for i in range(FEW):
        hit = F.get("_parts", F.lit(2 * i + 1))
        start = at + F.length(F.get("_parts", F.lit(2 * i)))
        at = start + F.length(hit)
        places.append(F.struct(start.alias("start"), at.alias("end"), hit.alias("text")))
    few = (F.size("_parts") <= 2 * FEW + 1) & ~F.contains(text, F.lit(mark))
    spans = F.when(few, F.slice(F.array(*places), F.lit(1), F.floor(F.size("_parts") / 2).cast("int"))).otherwise(_spans(text, F.lit(pattern)))
    # From an inner explosion Spark infers a filter that repeats all of this.
    return met.select("doc_id", "text", spans.alias("spans")).select("doc_id", "text", F.posexplode_outer("spans").alias("ord", "s")).where("s is not null")


def number_tokens(documents: DataFrame, native: bool = False, context: int = 90) -> DataFrame:
    """X-01, F-01, F-02, F-31: (doc_id, ord, start, end, token, before, after) of every number in the text."""
    cut = _cut_out(documents.where(F.col("text").rlike("[0-9]")), NATIVE_TOKEN if native else TOKEN)
    before = F.substring("text", F.greatest(F.lit(1), F.col("s.start") + 1 - context), F.least(F.lit(context), F.col("s.start")))
    return cut.select("doc_id", "ord", "s.start", "s.end", F.col("s.text").alias("token"), before.alias("before"), F.substring("text", F.col("s.end") + 1, F.lit(context)).alias("after"))


def repeats(tokens: DataFrame) -> DataFrame:
    """A-19, W-01: adds how often a token's text occurs in its document; pre-aggregated, so a very common token is no window of its own."""
    n = tokens.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("same_text"))
    return tokens.join(n.hint("merge"), ["doc_id", "token"])


# Region kinds and the patterns of what is blocked or has priority.
BLOCKED = {
    "comment": r"(?m)(?<!\\)%.*$",
    "verbatim": r"(?s)\\begin\{(verbatim|lstlisting|minted|comment)\*?\}.*?\\end\{\1\*?\}",
    "preamble": r"(?s)\A.*?\\begin\{document\}",
    "structural": r"\\(?:label|ref|eqref|cite[a-z]*|input|include|includegraphics|bibliography|usepackage|documentclass|vspace|hspace|setlength)\*?(?:\[[^\]]*\])*\{[^}]*\}",
    "fence": r"(?ms)^(```|~~~).*?^\1\s*$",
    "code": r"(?<!`)`[^`\n]+`(?!`)",
    "display_math": r"(?s)\$\$.*?\$\$",
    "front_matter": r"(?s)\A---\n.*?\n---\n",
    "html_comment": r"(?s)<!--.*?-->",
}
PRIORITY = {
    "abstract": r"(?s)\\begin\{abstract\}.*?\\end\{abstract\}|(?ms)^\#+\s*Abstract\s*$.*?(?=^\#|\z)",
    "table": r"(?s)\\begin\{(?:table|tabular)\*?\}.*?\\end\{(?:table|tabular)\*?\}",
}
DYNAMIC = r"\\(?:newcommand|renewcommand|def|let|csname|ifx|ifnum|loop|foreach|catcode)\b"


#: What a text must hold to have a region of a kind; looked up before the pattern is tried.
NEEDS = {"comment": "%", "verbatim": "\\begin{", "preamble": "\\begin{document}", "structural": "\\", "code": "`", "display_math": "$$", "front_matter": "---", "html_comment": "<!--", "table": "\\begin{tab"}


def _regions(text: Column, kinds: dict[str, str]) -> Column:
    """array<struct<kind,start,end>> of the regions of the given kinds in a text."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def one(kind: str, pattern: str) -> Column:
        found = F.transform(_spans(text, F.lit(pattern)), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return F.when(F.contains(text, F.lit(NEEDS.get(kind, ""))) & text.rlike(pattern), found).otherwise(none)

    return F.concat(none, *[one(k, p) for k, p in kinds.items()])


def regions(documents: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """X-02, X-12: (doc_id, kind, start, end) of every region of the given kinds; each text is read once for all of them."""
    return documents.select("doc_id", F.explode(_regions(F.col("text"), kinds)).alias("s")).select("doc_id", "s.kind", "s.start", "s.end").where("start < end")


def checkable(documents: DataFrame, tokens: DataFrame) -> DataFrame:
    """X-02: tokens of these documents outside blocked regions; a document with dynamic macros is blocked as a whole."""
    text = F.col("text")
    whole = F.when(text.rlike(DYNAMIC), F.array(F.struct(F.lit("dynamic").alias("kind"), F.lit(0).alias("start"), F.length(text).alias("end"))))
    found = documents.select("doc_id", F.explode(F.coalesce(whole, _regions(text, BLOCKED))).alias("s")).select("doc_id", F.col("s.start").alias("r_start"), F.col("s.end").alias("r_end"))
    # Regions of one kind don't overlap, so a place is in as many as there are kinds at most: merging them would cost more than it spares.
    return intervals.overlap_join(tokens, found.where("r_start < r_end"), how="left_anti")


# -- anchors --------------------------------------------------------------


def literal_hits(documents: DataFrame, literals: DataFrame) -> DataFrame:
    """X-06: (anchor_id, doc_id, start, end) of every non-overlapping occurrence of an exact literal; ``literals`` has anchor_id, doc_id and exact."""
    return _occurrences(documents.select("doc_id", "text").join(literals.where("length(exact) > 0").hint("merge"), "doc_id")).select("anchor_id", "doc_id", "start", "end")


def _occurrences(met: DataFrame) -> DataFrame:
    """Rows with ``text`` and ``exact``, not empty, once for each occurrence, with ``start`` and ``end`` instead of these two."""
    gaps = F.transform(F.split("text", F.concat(F.lit("\\Q"), F.replace("exact", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1), lambda g: F.length(g))
    n = F.col("n")
    starts = _let(gaps, lambda all_: _let(F.slice(all_, F.lit(1), F.size(all_) - 1), lambda g: F.zip_with(g, _sums_before(F.transform(g, lambda x: x + n)), lambda x, before: x + before)))
    kept = [c for c in met.columns if c not in ("text", "exact")]
    return met.withColumn("n", F.length("exact")).select(*kept, F.explode(starts).alias("start"), "n").select(*kept, "start", (F.col("start") + F.col("n")).alias("end"))


#: Characters of the literals that one automaton holds, on average at most.
BATCH_CHARS = 1_000_000


def literals_anywhere(documents: DataFrame, literals: DataFrame, chars: int = BATCH_CHARS) -> DataFrame:
    """X-06 without a known document: (anchor_id, doc_id, start, end) of every non-overlapping occurrence of each literal (anchor_id, exact) in all documents.

    The different literals are dealt by hash into batches of bounded size; a
    worker builds one automaton for a batch and reads each text once for all of
    its literals.  Empty literals are found nowhere.
    """
    different = literals.where("length(exact) > 0").select("exact").distinct()
    size = different.agg(F.coalesce(F.sum(F.length("exact")), F.lit(0))).first()[0]
    batches = max(1, -(-2 * size // chars)) if size > chars // 2 else 1
    dealt = different.withColumn("batch", F.pmod(F.xxhash64("exact"), F.lit(batches)).cast("int"))
    texts = documents.select("doc_id", "text").where("text is not null")
    kind = documents.select("doc_id").schema[0].dataType.simpleString()
    found = None
    for k in range(batches):
        own = sorted(r.exact for r in dealt.where(F.col("batch") == k).collect())  # one batch, of bounded size
        one = texts.mapInArrow(partial(_scan, literals=own, key=uuid.uuid4().hex), f"doc_id {kind}, exact string, start int, end int")
        found = one if found is None else found.unionByName(one)
    return literals.select("anchor_id", "exact").join(found, "exact").select("anchor_id", "doc_id", "start", "end")


@lru_cache(maxsize=2)
def _automaton(key: str, literals: tuple[str, ...]) -> ahocorasick.Automaton | None:
    out = ahocorasick.Automaton()
    for i, x in enumerate(literals):
        out.add_word(x, (i, len(x)))
    out.make_automaton()
    return out if literals else None


def _scan(batches, literals: list[str], key: str):
    automaton = _automaton(key, tuple(literals))
    for batch in batches:
        at, which, starts, ends = [], [], [], []
        for row, text in enumerate(batch.column("text").to_pylist() if automaton else []):
            last: dict[int, int] = {}
            for end, (i, size) in automaton.iter(text):
                start = end + 1 - size
                if start >= last.get(i, 0):
                    last[i] = end + 1
                    at.append(row)
                    which.append(literals[i])
                    starts.append(start)
                    ends.append(end + 1)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(which, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "exact", "start", "end"])


def between_hits(documents: DataFrame, anchors: DataFrame, most: int = 1000) -> DataFrame:
    """X-07: (anchor_id, doc_id, start, end) between every occurrence of a prefix and the first suffix within ``most`` characters behind it.

    Prefix hits may overlap.  ``anchors`` has anchor_id, doc_id, prefix, suffix.
    """
    met = documents.select("doc_id", "text").join(anchors.where("length(prefix) > 0 and length(suffix) > 0").hint("merge"), "doc_id").where(F.contains("text", F.col("prefix")))
    hit = met.select("anchor_id", "doc_id", "text", "suffix", F.explode(_prefix_hits(F.col("text"), F.col("prefix"))).alias("p"), F.length("prefix").alias("n")).withColumn("start", F.col("p") + F.col("n"))
    end = F.expr("locate(suffix, text, start + 1) - 1")
    return hit.withColumn("end", end).where((F.col("end") >= F.col("start")) & (F.col("end") - F.col("start") <= most)).select("anchor_id", "doc_id", "start", "end")


def _prefix_hits(text: Column, prefix: Column) -> Column:
    """Where a prefix, not empty, occurs in a text; its hits may overlap."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(prefix, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    pieces = F.transform(F.split(text, quoted, -1), lambda p: F.length(p))
    # Splitting before each hit gives pieces whose lengths add up to the hits' places; a hit at 0 makes no empty piece.
    starts = _let(pieces, lambda all_: _let(F.slice(all_, F.lit(1), F.greatest(F.size(all_) - 1, F.lit(0))), lambda g: F.zip_with(g, _sums_before(g), lambda x, before: x + before)))
    return F.when(F.startswith(text, prefix), F.array_distinct(F.array_prepend(starts, F.lit(0)))).otherwise(starts)


def sole_places(rows: DataFrame, most: int = 1000) -> DataFrame:
    """X-07, A-28 where each row has its own text, prefix and suffix: adds start, end and error as ``unique_or_unknown`` gives them for ``between_hits``.

    Nothing is joined or exploded.  Two places at most are found by searching;
    only a text that holds the prefix more often is cut at each of its hits.
    """
    text, prefix, suffix = F.col("text"), F.col("prefix"), F.col("suffix")
    there = (F.length(prefix) > 0) & (F.length(suffix) > 0)
    # Places from 1, as Spark's search has them; 0 is none.
    out = rows.withColumn("_p1", F.when(there, F.coalesce(F.position(prefix, text), F.lit(0))).otherwise(0))
    out = out.withColumn("_p2", F.when(F.col("_p1") > 0, F.position(prefix, text, F.col("_p1") + 1)).otherwise(0))
    out = out.withColumn("_p3", F.when(F.col("_p2") > 0, F.position(prefix, text, F.col("_p2") + 1)).otherwise(0))

    def place(p: Column) -> Column:
        start = p + F.length(prefix) - 1
        return F.struct(start.alias("start"), (F.position(suffix, text, start + 1) - 1).alias("end"))

    held = lambda s: (s["end"] >= s["start"]) & (s["end"] - s["start"] <= most)
    for i in (1, 2):
        out = out.withColumn(f"_s{i}", F.when(F.col(f"_p{i}") > 0, place(F.col(f"_p{i}"))))
        out = out.withColumn(f"_s{i}", F.when(held(F.col(f"_s{i}")), F.col(f"_s{i}")))
    few = F.when(F.col("_s1").isNull(), F.array("_s2")).when(F.col("_s2").isNull(), F.array("_s1")).otherwise(F.array("_s1", "_s2"))
    many = F.filter(F.transform(_prefix_hits(text, prefix), lambda p: place(p + 1)), held)
    out = out.withColumn("_hits", F.array_compact(F.when(F.col("_p3") > 0, many).otherwise(few)))
    one = F.size("_hits") == 1
    error = F.when(F.size("_hits") == 0, "ANCHOR_MISSING").when(~one, "ANCHOR_AMBIGUOUS")
    hit = F.when(one, F.get("_hits", F.lit(0)))
    return out.select(*rows.columns, hit["start"].alias("start"), hit["end"].alias("end"), error.alias("error"))


def unique_or_unknown(anchors: DataFrame, hits: DataFrame) -> DataFrame:
    """A-28, N3: (anchor_id, hits, start, end, error): the one place of each anchor, counting every hit, also in comments."""
    n = hits.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("hits"), F.min("start").alias("start"), F.min("end").alias("end"))
    out = anchors.select("anchor_id").join(n.hint("merge"), "anchor_id", "left")
    one = F.col("hits") == 1
    return out.select("anchor_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.when(one, F.col("start")).alias("start"), F.when(one, F.col("end")).alias("end"), F.when(F.col("hits").isNull(), "ANCHOR_MISSING").when(~one, "ANCHOR_AMBIGUOUS").alias("error"))


def blocks(documents: DataFrame) -> DataFrame:
    """F-32: (doc_id, block, start, end, text, identity) of paragraphs, their identity taken with all numbers masked."""
    cut = _cut_out(documents, r"(?s)\S.*?(?=\n[ \t]*\n|\z)").withColumnRenamed("ord", "block")
    return cut.select("doc_id", "block", "s.start", "s.end", F.col("s.text").alias("text"), sha256(F.regexp_replace("s.text", NATIVE_TOKEN, "<number>")).alias("identity"))


def locate_in_block(documents: DataFrame, anchors: DataFrame) -> DataFrame:
    """X-08: places of (anchor_id, doc_id, identity, exact) inside the one block of that identity; none where several blocks have it."""
    own = blocks(documents).groupBy("doc_id", "identity").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("b_start"), F.min("text").alias("text")).where("n = 1").drop("n")
    inside = anchors.where("length(exact) > 0").join(own.hint("merge"), ["doc_id", "identity"]).select("anchor_id", "doc_id", "b_start", "text", "exact")
    placed = _occurrences(inside).select("anchor_id", "doc_id", (F.col("start") + F.col("b_start")).alias("start"), (F.col("end") + F.col("b_start")).alias("end"))
    return unique_or_unknown(anchors, placed)


class _Places:
    """Where the substrings of a text occur, by rolling hashes: one sorted list of hashes for each length that is asked for."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(codes)
        with np.errstate(over="ignore"):
            codes = (codes + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
            codes ^= codes >> np.uint64(29)
            up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (self.BASE, pow(self.BASE, -1, 2**64)))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[:-1])])
        self.down, self.lists = down, {}

    def of(self, start: int, size: int) -> np.ndarray:
        """All starts of the substring, rising."""
        if size not in self.lists:
            with np.errstate(over="ignore"):
                hashes = (self.sums[size:] - self.sums[: len(self.sums) - size]) * self.down[: len(self.sums) - size]
            order = np.argsort(hashes, kind="stable")
            self.lists[size] = hashes, hashes[order], order
        hashes, rising, order = self.lists[size]
        left, right = np.searchsorted(rising, hashes[start], "left"), np.searchsorted(rising, hashes[start], "right")
        return order[left:right]

    def alone(self, start: int, end: int, before: int, after: int, most: int) -> bool:
        """Whether only here a suffix follows within ``most`` behind a prefix."""
        ends, suffixes = self.of(start - before, before) + before, self.of(end, after)
        found = 0
        for k in range(0, len(ends), 1024):  # mostly settled by the first few
            part = ends[k : k + 1024]
            at = np.searchsorted(suffixes, part)
            gap = suffixes[np.minimum(at, len(suffixes) - 1)] - part
            held = (at < len(suffixes)) & (gap <= most)
            found += int(held.sum())
            if found > 1 or (held & ((part != start) | (gap != end - start))).any():
                return False
        return found == 1


_CONTEXTS = sorted(((2**i, 2**j) for i in range(10) for j in range(10)), key=lambda c: (c[0] + c[1], c[0]))


def _alone_near(text: str, start: int, end: int, before: int, after: int) -> bool:
    """``_Places.alone`` in a text no longer than a suffix may be away: every prefix with a suffix behind it counts, so two of them settle it."""
    prefix, suffix = text[start - before : start], text[end : end + after]
    at, found = text.find(prefix), 0
    while at >= 0:
        behind = text.find(suffix, at + before)
        if behind < 0:  # nor behind any later prefix
            break
        found += 1
        if found > 1 or at + before != start or behind != end:
            return False
        at = text.find(prefix, at + 1)
    return found == 1


def _anchored(batches, most: int = 1000):
    """(target ids, prefixes, suffixes) of each batch; lists of hashes are only made for texts longer than ``most``."""
    token = re.compile(NATIVE_TOKEN, re.ASCII)
    for batch in batches:
        targets = batch.column("targets")
        asked = targets.flatten()
        sizes = targets.value_lengths().to_pylist()
        ids, starts, ends = asked.field("target_id"), asked.field("start").to_pylist(), asked.field("end").to_pylist()
        prefixes, suffixes = [None] * len(asked), [None] * len(asked)
        at = 0
        for text, size in zip(batch.column("text").to_pylist(), sizes, strict=True):
            first, at = at, at + size
            spans = [m.span() for m in token.finditer(text or "")]
            nth = {s: i for i, (s, _) in enumerate(spans)}
            places = None
            for k in range(first, at):
                start, end = starts[k], ends[k]
                i = nth.get(start)
                if i is None or end is None or not start <= end <= len(text):
                    continue
                if len(text) > most:
                    places = places or _Places(text)
                low, high = spans[i - 1][1] if i else 0, spans[i + 1][0] if i + 1 < len(spans) else len(text)
                tried = set()
                for before, after in _CONTEXTS:
                    context = min(before, start - low), min(after, high - end)
                    if min(context) > 0 and context not in tried and (places.alone(start, end, *context, most) if places else _alone_near(text, start, end, *context)):
                        prefixes[k], suffixes[k] = text[start - context[0] : start], text[end : end + context[1]]
                        break
                    tried.add(context)
        yield ids, prefixes, suffixes


def synthesise_anchors(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """X-09: the smallest (before, after) context from {1, 2, 4 ... 512} that places each target (target_id, doc_id, start, end) uniquely.

    Contexts stop at neighbouring numbers (W-06).  One row for each target
    with prefix and suffix, or the error NO_UNIQUE_ANCHOR.  A text is read
    once, with all of its targets; in a long one a context's uniqueness is
    looked up in lists of hashes, which are made once for each length.
    """
    kind = targets.schema["target_id"].dataType
    asked = targets.groupBy("doc_id").agg(F.collect_list(F.struct("target_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("targets"))
    arrow = to_arrow_type(kind)

    def run(batches):
        for ids, prefixes, suffixes in _anchored(batches):
            yield pa.RecordBatch.from_arrays([ids.cast(arrow), pa.array(prefixes, pa.string()), pa.array(suffixes, pa.string())], ["target_id", "prefix", "suffix"])

    found = documents.select("doc_id", "text").join(asked.hint("merge"), "doc_id").select("text", "targets").mapInArrow(run, f"target_id {kind.simpleString()}, prefix string, suffix string")
    return targets.select("target_id").join(found.hint("merge"), "target_id", "left").select("target_id", "prefix", "suffix", F.when(F.col("prefix").isNull(), "NO_UNIQUE_ANCHOR").alias("error"))


def line_and_column(documents: DataFrame, places: DataFrame) -> DataFrame:
    """W-13, F-34: adds line, column (from 1) and byte_start to places (doc_id, start)."""
    head = F.substring("text", F.lit(1), F.col("start"))
    met = places.join(documents.select("doc_id", "text").hint("merge"), "doc_id")
    return met.withColumns({"line": F.regexp_count(head, F.lit("\n")) + 1, "column": F.col("start") - (F.length(head) - F.length(F.substring_index(head, "\n", -1))) + 1, "byte_start": F.octet_length(head)}).drop("text")


def figure_references(documents: DataFrame) -> DataFrame:
    """X-13: (doc_id, target) of every included graphic."""
    return documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\\includegraphics\*?(?:\[[^\]]*\])?\{([^}]+)\}"), F.lit(1))).alias("target")).union(documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), F.lit(1))).alias("target")))


def resolve_figures(references: DataFrame, files: DataFrame) -> DataFrame:
    """J-22: each reference (file, target) with the one registered path (path) it can mean, or why there is none."""
    folder = F.regexp_extract("file", r"^(.*/)[^/]*$", 1)
    suffixes = F.array(*map(F.lit, ["", ".pdf", ".png", ".jpg", ".jpeg", ".eps"]))
    tries = F.array_distinct(F.flatten(F.transform(F.array(F.lit(""), folder), lambda d: F.transform(suffixes, lambda s: F.concat(d, F.col("target"), s)))))
    hits = references.select("file", "target", F.explode(tries).alias("path")).join(files.select("path").distinct().hint("merge"), "path").groupBy("file", "target").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path"))
    return references.distinct().join(hits.hint("merge"), ["file", "target"], "left").select("file", "target", F.when(F.col("n") == 1, F.col("path")).alias("path"), F.when(F.col("n").isNull(), "FIGURE_MISSING").when(F.col("n") > 1, "FIGURE_AMBIGUOUS").alias("error"))


def section_paths(lines: DataFrame) -> DataFrame:
    """W-10: (doc_id, line, path): the headings in force at each line; a shallower heading resets the deeper ones."""
    level = F.length(F.regexp_extract("text", r"^(#{1,6})\s", 1))
    marked = lines.withColumns({"level": level, "title": F.regexp_extract("text", r"^#{1,6}\s+(.*?)\s*#*$", 1)})

    def last(k: int):
        return F.when((F.col("level") > 0) & (F.col("level") <= k), F.struct((F.col("level") == k).alias("here"), F.col("title").alias("title")))

    out = scans.Runs(marked, ["doc_id"], ["line"]).running(**{f"h{k}": ("last", last(k)) for k in range(1, 7)}).result()
    kept = F.array(*[F.when(F.col(f"h{k}.here"), F.col(f"h{k}.title")) for k in range(1, 7)])
    return out.select("doc_id", "line", F.array_join(F.filter(kept, lambda x: x.isNotNull()), " / ").alias("path"))


def apply_patches(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """X-14, W-09: documents (doc_id, text) with changes (doc_id, start, end, before, after) put in, or an error and the text as it was.

    Refused as a whole where changes overlap, leave the text, or where the
    text at a change is no longer ``before``.  A text is cut once at its sorted
    changes and its pieces joined once, whatever their number.
    """
    own = changes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "before", "after"))).alias("c"))
    met = documents.select("doc_id", "text").join(own.hint("merge"), "doc_id", "left")

    def run(batches):
        for batch in batches:
            done = [_patched(text, c) for text, c in zip(batch.column("text").to_pylist(), batch.column("c").to_pylist(), strict=True)]
            texts, errors = zip(*done, strict=True) if done else ((), ())
            changed = [bool(c) and e is None for c, e in zip(batch.column("c").to_pylist(), errors, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(errors, pa.string()), pa.array(changed, pa.bool_())], ["doc_id", "text", "error", "changed"])

    return met.mapInArrow(run, f"doc_id {met.schema['doc_id'].dataType.simpleString()}, text string, error string, changed boolean")


def _patched(text: str | None, changes: list[dict] | None) -> tuple[str | None, str | None]:
    if not changes:
        return text, None
    size = len(text or "")
    if any(c["start"] is None or c["end"] is None or not 0 <= c["start"] <= c["end"] <= size for c in changes):
        return text, "PATCH_RANGE"
    if any(a["end"] > b["start"] for a, b in pairwise(changes)):
        return text, "PATCH_OVERLAP"
    if any(text[c["start"] : c["end"]] != c["before"] for c in changes):
        return text, "PATCH_STALE"
    pieces, at = [], 0
    for c in changes:
        pieces += [text[at : c["start"]], c["after"] or ""]
        at = c["end"]
    return "".join([*pieces, text[at:]]), None
