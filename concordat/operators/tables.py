"""Cells of LaTeX tables and Markdown pipe tables, and how cells are named and found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.functions.lexeme import NATIVE_TOKEN

_CELL = "doc_id, table_id, row, col, cell"


def clean(cell: Column) -> Column:
    """F-30: a LaTeX cell without comments, rules and doubled white space."""
    bare = F.regexp_replace(F.regexp_replace(cell, r"(?m)(?<!\\)%.*$", ""), r"\\(?:hline|toprule|midrule|bottomrule)|\\cline\{[^}]*\}|\\cmidrule(?:\([^)]*\))?\{[^}]*\}", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def latex_cells(documents: DataFrame) -> DataFrame:
    """X-03: (doc_id, table_id, row, col, cell) of literal tables.

    Cells end at ``&`` and rows at ``\\\\``.  Tables with multicolumn or
    multirow, and rows whose cells have unbalanced braces (a separator stood
    inside braces), are unsupported: the whole table gives no cells.
    """
    body = F.regexp_extract_all("text", F.lit(r"(?s)\\begin\{tabular(?:\}|\*\}\{[^}]*\})\{[^}]*\}(.*?)\\end\{tabular\*?\}"), F.lit(1))
    tables = documents.select("doc_id", F.posexplode(body).alias("table_id", "body")).where(~F.col("body").rlike(r"\\multi(?:column|row)\b"))
    rows = tables.select("doc_id", "table_id", F.posexplode(F.split("body", r"(?<!\\)\\\\(?:\[[^\]]*\])?")).alias("row", "line")).where(clean(F.col("line")) != "")
    w = Window.partitionBy("doc_id", "table_id")
    rows = rows.withColumn("row", (F.row_number().over(w.orderBy("row")) - 1).cast("int"))
    cells = rows.select("doc_id", "table_id", "row", F.posexplode(F.split("line", r"(?<!\\)&")).alias("col", "raw"))
    open_, close = (F.regexp_count("raw", F.lit(rf"(?<!\\)\{b}")) for b in "{}")
    return cells.withColumn("bad", F.max((open_ != close).cast("int")).over(w)).where("bad = 0").select("doc_id", "table_id", "row", "col", clean(F.col("raw")).alias("cell"))


def pipe_cells(documents: DataFrame) -> DataFrame:
    """X-04: (doc_id, table_id, row, col, cell, caption) of pipe tables; row 0 is the header.

    A table is a header line, a separator line and lines with pipes up to the
    next other line; it is taken only if all its rows have the same 2 to 100
    cells.  The caption is the nearest line before it that reads ``Table N``.
    """
    piped = documents.where(F.contains("text", F.lit("|")) & F.col("text").rlike(r"(?m)^\s*\|?\s*:?-+:?\s*\|"))
    lines = piped.select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("line", "text"))
    ordered = Window.partitionBy("doc_id").orderBy("line")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    separator = F.col("text").rlike(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)+\|?\s*$")
    marked = lines.withColumns({"sep": separator, "pipe": F.contains("text", F.lit("|"))})
    marked = marked.withColumns({"head": F.lead("sep").over(ordered) & F.col("pipe") & ~F.col("sep"), "gap": F.sum((~F.col("pipe")).cast("int")).over(so_far), "caption": F.last(F.when(F.col("text").rlike(r"(?i)^\W*table\s+\d+"), F.trim("text")), ignorenulls=True).over(so_far)})
    marked = marked.withColumn("table_id", F.sum(F.col("head").cast("int")).over(so_far))
    within = Window.partitionBy("doc_id", "gap")
    body = marked.where(F.col("pipe") & ~F.col("sep")).withColumn("first", F.min(F.when(F.col("head"), F.col("line"))).over(Window.partitionBy("doc_id", "gap", "table_id"))).where(F.col("line") >= F.col("first"))
    inner = F.regexp_replace(F.regexp_replace(F.trim("text"), r"^\|", ""), r"(?<!\\)\|$", "")
    body = body.withColumn("cells", F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(c)))
    key = ["doc_id", "gap", "table_id"]
    sizes = body.groupBy(*key).agg(F.min(F.size("cells")).alias("low"), F.max(F.size("cells")).alias("high")).where("low = high and low between 2 and 100")
    good = body.join(sizes, key, "left_semi").withColumn("row", (F.row_number().over(Window.partitionBy(*key).orderBy("line")) - 1).cast("int"))
    good = good.withColumn("table_id", (F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first")) - 1).cast("int"))
    del within
    return good.select("doc_id", "table_id", "row", F.posexplode("cells").alias("col", "cell"), "caption")


def header_rows(cells: DataFrame) -> DataFrame:
    """W-07, W-08: (doc_id, table_id, row, is_header): rows before the first one with a number outside its first cell."""
    rows = cells.groupBy("doc_id", "table_id", "row").agg(F.max((F.col("cell").rlike(NATIVE_TOKEN) & (F.col("col") > 0)).cast("int")).alias("has"))
    w = Window.partitionBy("doc_id", "table_id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("is_header", F.max("has").over(w) == 0).select("doc_id", "table_id", "row", "is_header")


def keyed_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, headers, values): each body row with its cells, and the table's last header row."""
    rows = cells.groupBy("doc_id", "table_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "cell"))), lambda x: x["cell"]).alias("values"))
    marked = rows.join(header_rows(cells), ["doc_id", "table_id", "row"])
    head = marked.where("is_header").groupBy("doc_id", "table_id").agg(F.max_by("values", "row").alias("headers"))
    return marked.where("not is_header").join(head, ["doc_id", "table_id"], "left").select("doc_id", "table_id", "row", "headers", "values")


def locate_cells(cells: DataFrame, anchors: DataFrame) -> DataFrame:
    """X-05, X-18: (anchor_id, hits, table_id, row, cell, error): the one cell with equal headers, row prefix and column.

    ``anchors`` has anchor_id, doc_id, headers, row_prefix (arrays) and column
    (an index).  The cell must hold exactly one number.
    """
    met = anchors.join(keyed_rows(cells), ["doc_id", "headers"]).where(F.slice("values", F.lit(1), F.greatest(F.size("row_prefix"), F.lit(1))) == F.col("row_prefix"))
    met = met.withColumn("cell", F.get("values", F.col("column"))).where("cell is not null")
    n = met.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("table_id", "row", "cell")).alias("at"))
    out = anchors.select("anchor_id").join(n, "anchor_id", "left")
    numbers = F.regexp_count(F.col("at.cell"), F.lit(NATIVE_TOKEN))
    error = F.when(F.col("hits").isNull(), "ANCHOR_MISSING").when(F.col("hits") > 1, "ANCHOR_AMBIGUOUS").when(numbers != 1, "NUMERIC_ANCHOR")
    good = error.isNull()
    return out.select("anchor_id", F.coalesce("hits", F.lit(0)).alias("hits"), *[F.when(good, F.col(f"at.{c}")).alias(c) for c in ("table_id", "row", "cell")], error.alias("error"))


def row_prefixes(cells: DataFrame) -> DataFrame:
    """X-10: (doc_id, table_id, row, prefix, error): for each row the fewest leading cells that no other row of tables with these headers shares."""
    rows = keyed_rows(cells)
    tried = rows.select("doc_id", "table_id", "row", "headers", F.explode(F.transform(F.sequence(F.lit(1), F.size("values")), lambda k: F.slice("values", F.lit(1), k))).alias("prefix"))
    # A prefix that one row alone has is known by its only row.
    one = tried.groupBy("doc_id", "headers", "prefix").agg(F.count(F.lit(1)).alias("n"), F.min("table_id").alias("table_id"), F.min("row").alias("row")).where("n = 1")
    least = one.groupBy("doc_id", "table_id", "row").agg(F.min_by("prefix", F.size("prefix")).alias("prefix"))
    return rows.select("doc_id", "table_id", "row").join(least, ["doc_id", "table_id", "row"], "left").withColumn("error", F.when(F.col("prefix").isNull(), "ANCHOR_AMBIGUOUS"))


def number_contexts(cells: DataFrame) -> DataFrame:
    """F-33: (doc_id, table_id, row, col, ord, token, shape, left, right): each number of a cell, the cell with numbers masked, and the text on both sides."""
    gaps = F.split("cell", NATIVE_TOKEN, -1)
    found = F.regexp_extract_all("cell", F.lit(NATIVE_TOKEN), F.lit(0))
    base = cells.where(F.col("cell").rlike(NATIVE_TOKEN)).withColumns({"gaps": gaps, "found": found})
    out = base.select("doc_id", "table_id", "row", "col", "gaps", F.posexplode("found").alias("ord", "token"))
    return out.select("doc_id", "table_id", "row", "col", "ord", "token", F.array_join("gaps", "<number>").alias("shape"), F.get("gaps", F.col("ord")).alias("left"), F.get("gaps", F.col("ord") + 1).alias("right"))


def location_context(cells: DataFrame) -> DataFrame:
    """X-11: (doc_id, table_id, row, col, row_text, column_header): the row with the cell's own value masked, and what stands over the column."""
    rows = keyed_rows(cells)
    out = rows.select("doc_id", "table_id", "row", "headers", "values", F.posexplode("values").alias("col", "cell")).where(F.col("cell").rlike(NATIVE_TOKEN))
    masked = F.array_join(F.transform("values", lambda v, i: F.when(i == F.col("col"), "[value]").otherwise(v)), " | ")
    return out.select("doc_id", "table_id", "row", "col", masked.alias("row_text"), F.get("headers", F.col("col")).alias("column_header"))
