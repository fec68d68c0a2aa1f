"""Ranked suggestions: which table cells may report which metric, by declared identity and never by the measured value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.operators import scans


def plain(text: Column) -> Column:
    """F-26: text for matching: without macros and braces, folded to lower case (and ß to ss)."""
    return F.replace(F.lower(F.regexp_replace(F.regexp_replace(text, r"\\[A-Za-z]+\*?", " "), r"[{}$]", "")), F.lit("ß"), F.lit("ss"))


def contains_term(text: Column, term: Column) -> Column:
    """F-27: the term as a whole, not inside a word or a longer number."""
    quoted = F.concat(F.lit(r"(?U)(?<![\w.])\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![\w.])"))
    return F.regexp_like(text, quoted)


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """J-09: labels (column, label) that stand for more than one value."""
    return aliases.groupBy("column", F.lower(F.trim("label")).alias("label")).agg(F.count_distinct("value").alias("n")).where("n > 1").select("column", "label", F.lit("ALIAS_CONFLICT").alias("error"))


def suggest(choices: DataFrame, locations: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """J-08, U-11, W-02, W-03: (choice, location, matched, missing, field_match, rank, ties) of all locations that match a choice.

    ``choices`` has choice, identity (map of column to value) and field;
    ``locations`` has location (unique), row_text, column_header and is_table.
    Rows are cut into words, and the word of a term that the fewest rows have
    joins them; whole terms are then verified, so nothing is compared with
    everything.  Only words and ids meet in that join; the rows' texts come in
    for the pairs alone.  ``rank`` orders by the number of matched columns, the
    field in the header, tables first, and the location; ``ties`` counts those
    that share the best rank's merits.
    """
    terms = choices.select("choice", "field", F.map_keys("identity").alias("columns"), F.explode("identity").alias("column", "term"))
    if aliases is not None:
        conflicts = alias_conflicts(aliases).select(F.col("column").alias("c"), F.col("label").alias("l"))
        clean = aliases.join(conflicts, (F.lower(F.trim("label")) == F.col("l")) & (F.col("column") == F.col("c")), "left_anti")
        more = terms.join(clean.select(F.col("column").alias("c"), F.col("label").alias("l"), F.col("value").alias("v")), (F.col("column") == F.col("c")) & (F.col("term") == F.col("v"))).select("choice", "field", "columns", "column", F.col("l").alias("term"))
        terms = terms.unionByName(more)
    def cut(text: Column) -> Column:
        return F.array_distinct(F.filter(F.split(text, r"(?U)[^\w]+"), lambda x: x != ""))

    rows = locations.select("location", "is_table", plain(F.coalesce("row_text", F.lit(""))).alias("row_plain"), plain(F.coalesce("column_header", F.lit(""))).alias("head_plain"))
    asked = terms.withColumn("term_words", cut(plain(F.col("term")))).where(F.size("term_words") > 0)
    words = asked.select(F.explode("term_words").alias("word")).distinct()
    held = rows.select("location", F.explode(cut(F.col("row_plain"))).alias("word")).join(words, "word", "left_semi")
    often = held.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # A word that no row has rules its term out: it counts 0 and then meets nothing.
    each = asked.select("term", F.explode("term_words").alias("word")).distinct().join(often, "word", "left")
    rarest = each.groupBy("term").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    pairs = asked.drop("term_words").join(rarest, "term").join(held, "word").drop("word")
    met = pairs.join(rows, "location").where(contains_term(F.col("row_plain"), plain(F.col("term"))))
    in_head = F.coalesce(F.max(contains_term(F.col("head_plain"), plain(F.col("field"))).cast("int")), F.lit(0))
    found = met.groupBy("choice", "location").agg(F.array_sort(F.collect_set("column")).alias("matched"), F.first("columns").alias("columns"), in_head.alias("field_match"), F.coalesce(F.first("is_table"), F.lit(False)).alias("is_table"))
    return ranked(found).select("choice", "location", "matched", F.array_sort(F.array_except("columns", "matched")).alias("missing"), "field_match", "is_table", "rank", "merit", "ties")


def ranked(found: DataFrame) -> DataFrame:
    """W-02, W-03: adds rank, merit and ties to the locations of each choice (choice, location, matched, field_match, is_table).

    A choice has few different merits, which a window ranks by their counts;
    the places within one merit are a segmented scan, so a choice may have any
    number of locations.
    """
    by = ["n_matched", "field_match", "is_table"]
    sized = found.withColumn("n_matched", F.size("matched"))
    counts = sized.groupBy("choice", *by).agg(F.count(F.lit(1)).alias("same"))
    w = Window.partitionBy("choice").orderBy(*[F.desc(c) for c in by])
    steps = counts.select("choice", *by, F.row_number().over(w).alias("merit"), F.coalesce(F.sum("same").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("better"), F.first("same").over(w).alias("ties"))
    placed = scans.Runs(sized.join(steps, ["choice", *by]), ["choice", "merit"], ["location"]).running(place=("sum", F.lit(1).cast("long"))).result()
    return placed.withColumn("rank", F.col("better") + F.col("place")).drop("n_matched", "better", "place")


def best(ranked: DataFrame, show: int = 3) -> DataFrame:
    """W-03: up to ``show`` of the suggestions that share the best rank, each with the number of ties."""
    return ranked.where((F.col("merit") == 1) & (F.col("rank") <= show))


def search(rows: DataFrame, query: str, columns: list[str], **equal) -> DataFrame:
    """P-14, P-15: rows whose named columns hold the query, whatever the case, and whose other columns equal what is asked."""
    text = plain(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    needle = query.casefold()
    out = rows.where(F.contains(text, F.lit(needle))) if query else rows
    for c, v in equal.items():
        if v is not None:
            out = out.where(F.col(c) == v)
    return out


def candidate_order(tokens: DataFrame) -> DataFrame:
    """T-01: abstract before tables before repeated numbers before the rest, then by file and place."""
    hint = F.when(F.col("region") == "abstract", 0).when(F.col("region") == "table", 1).when(F.col("same_text") > 1, 2).otherwise(3)
    return tokens.withColumn("hint", hint).orderBy("hint", "doc_id", "start")


def first_n(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """T-03, T-06: the first n rows of each group, with the group's total and whether more were left out."""
    w = Window.partitionBy(*by)
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    cut = rows.withColumn("place", F.row_number().over(w.orderBy(*order))).where(F.col("place") <= n)
    return cut.join(total, by).withColumn("truncated", F.col("total") > n)


def reused_metrics(generated: DataFrame, declared: DataFrame) -> DataFrame:
    """J-29: generated choices that equal a declared metric take its name."""
    return generated.join(declared.groupBy("definition").agg(F.min("metric").alias("declared")), "definition", "left").select("choice", F.coalesce("declared", "choice").alias("metric"), F.col("declared").isNotNull().alias("reused"))


def merge_conflicts(existing: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """U-06, U-07: names that both sides declare; the merge is refused if there are any."""
    return existing.select(key).intersect(added.select(key)).withColumn("error", F.lit("NAME_CONFLICT"))


def unavailable(selected: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """U-07: selected names that aren't available or were chosen twice."""
    n = selected.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.join(available.select(key).distinct().withColumn("there", F.lit(True)), key, "left").where("there is null or n > 1").select(key, F.when(F.col("there").isNull(), "NOT_AVAILABLE").otherwise("CHOSEN_TWICE").alias("error"))
