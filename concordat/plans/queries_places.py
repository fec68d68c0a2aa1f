"""Queries on places in documents: tables and their cells, anchors, sections, includes and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.operators import graphs, tables, textscan
from concordat.plans import check as ck
from concordat.plans.register import Register
from concordat.plans.vehicles import table

_r = Register()
query = _r.query


def _money(column: str):
    return F.col(column).cast("decimal(18,2)").cast("string")


# -- tables: suppliers in literal LaTeX tables of twenty --------------------

_SUPPLIERS = """s as (select s_suppkey // 20 as doc_id, s_suppkey, s_name as name, cast(s_nationkey as varchar) as nation, cast(cast(s_acctbal as decimal(18,2)) as varchar) as balance,
  cast(row_number() over (partition by s_suppkey // 20 order by s_suppkey) as integer) as "row" from supplier)"""


def _latex_tables(spark: SparkSession, sf_dir: str, columns: tuple[str, str] = ("s_name", "s_nationkey")) -> DataFrame:
    """(doc_id, text): one table for each twenty suppliers."""
    line = F.concat_ws(" & ", F.col(columns[0]).cast("string"), F.col(columns[1]).cast("string"), _money("s_acctbal"))
    rows = table(spark, sf_dir, "supplier").groupBy(F.floor(F.col("s_suppkey") / 20).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("line")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: F.concat(r["line"], F.lit(" \\\\\n"))), "")
    return rows.select("doc_id", F.concat(F.lit("Suppliers.\n\\begin{tabular}{lrr}\n\\toprule\nname & nation & balance \\\\ \\midrule\n"), body, F.lit("\\bottomrule\n\\end{tabular}\n")).alias("text"))


@query(f"""with {_SUPPLIERS}, h as (select distinct doc_id from s)
  select doc_id, 0 as "row", col, cell from h, (values (0, 'name'), (1, 'nation'), (2, 'balance')) v(col, cell)
  union all select doc_id, "row", 0, name from s union all select doc_id, "row", 1, nation from s union all select doc_id, "row", 2, balance from s""")
def latex_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-03, F-30."""
    return tables.latex_cells(_latex_tables(spark, sf_dir)).select("doc_id", "row", "col", "cell")


@query(f"""with {_SUPPLIERS} select doc_id, "row", false as is_header from s union all select distinct doc_id, 0, true from s""")
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-07, W-08."""
    return tables.header_rows(tables.latex_cells(_latex_tables(spark, sf_dir))).select("doc_id", "row", "is_header")


@query(f"""with {_SUPPLIERS} select s_suppkey as anchor_id, cast(case when s_suppkey % 10 = 0 then 0 else 1 end as bigint) as hits, case when s_suppkey % 10 <> 0 then "row" end as "row",
  case when s_suppkey % 10 <> 0 then balance end as cell, case when s_suppkey % 10 = 0 then 'ANCHOR_MISSING' end as error from s""")
def located_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-05, X-18: each supplier's balance by the table's headers, the row's first cell and the column; a tenth of the names stand nowhere."""
    cells = tables.latex_cells(_latex_tables(spark, sf_dir))
    name = F.when(F.col("s_suppkey") % 10 == 0, "nobody").otherwise(F.col("s_name"))
    anchors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("anchor_id"), F.floor(F.col("s_suppkey") / 20).alias("doc_id"), F.array(*map(F.lit, ("name", "nation", "balance"))).alias("headers"), F.array(name).alias("row_prefix"), F.lit(2).alias("column"))
    return tables.locate_cells(cells, anchors).select("anchor_id", "hits", "row", "cell", "error")


@query(f"""with {_SUPPLIERS}, n as (select *, count(*) over (partition by doc_id, nation) as same from s) select doc_id, "row", case when same = 1 then 1 else 2 end as cells, cast(null as varchar) as error from n""")
def row_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-10: how many leading cells name a row where the first cell is the nation."""
    cells = tables.latex_cells(_latex_tables(spark, sf_dir, ("s_nationkey", "s_name")))
    return tables.row_prefixes(cells).select("doc_id", "row", F.size("prefix").alias("cells"), "error")


@query(f"""with {_SUPPLIERS} select doc_id, "row", 1 as col, '<number>' as shape, nation as token from s union all select doc_id, "row", 2, '<number>', balance from s
  union all select doc_id, "row", 0, 'Supplier#<number>', replace(name, 'Supplier#', '') from s""")
def cell_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-33: the numbers of every cell with the cell's shape around them."""
    return tables.number_contexts(tables.latex_cells(_latex_tables(spark, sf_dir))).select("doc_id", "row", "col", "shape", "token")


@query(f"""with {_SUPPLIERS} select doc_id, "row", 0 as col, '[value] | ' || nation || ' | ' || balance as row_text, 'name' as column_header from s
  union all select doc_id, "row", 1, name || ' | [value] | ' || balance, 'nation' from s union all select doc_id, "row", 2, name || ' | ' || nation || ' | [value]', 'balance' from s""")
def cell_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-11."""
    return tables.location_context(tables.latex_cells(_latex_tables(spark, sf_dir))).drop("table_id")


# -- anchors: orders as short notes -----------------------------------------

_ORDERS = "o as (select o_orderkey as k, o_custkey as c, cast(cast(o_totalprice as decimal(18,2)) as varchar) as p from orders)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), _money("o_totalprice").alias("p"))


@query(f"""with {_ORDERS} select k as binding, case when k % 7 <> 0 and k % 2 = 1 then p end as actual, case when k % 7 = 0 then 'ANCHOR_MISSING' when k % 2 = 0 then 'ANCHOR_AMBIGUOUS' end as error from o""")
def between_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-07, A-28: prices between a prefix and the first suffix behind it; a prefix that stands twice or not at all gives an error."""
    o = _orders(spark, sf_dir)
    docs = o.select(F.col("k").alias("doc_id"), F.format_string("Order of customer %s costs %s now.\nLater it costs 5 now.", "c", "p").alias("text"))
    prefix = F.when(F.col("k") % 7 == 0, "is nowhere ").when(F.col("k") % 2 == 0, " costs ").otherwise(F.format_string("customer %s costs ", "c"))
    anchors = o.select(F.col("k").alias("binding"), F.col("k").alias("doc_id"), F.lit(None).cast("string").alias("exact"), prefix.alias("prefix"), F.lit(" now").alias("suffix"))
    return ck.located_texts(docs, anchors)


@query(f"""with {_ORDERS} select k as anchor_id, cast(case when k % 5 = 0 then 0 else 1 end as bigint) as hits, case when k % 5 <> 0 then 9 + len(cast(k as varchar)) end as start,
  case when k % 5 = 0 then 'ANCHOR_MISSING' end as error from o""")
def block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-08, F-32: the price in the one paragraph of its masked identity; where two paragraphs have it there is no place."""
    o = _orders(spark, sf_dir)
    first = F.format_string("Order %s: [%s]", "k", "p")
    docs = o.select(F.col("k").alias("doc_id"), F.concat(first, F.when(F.col("k") % 5 == 0, F.lit("\n\nOrder 1: [2]")).otherwise(F.format_string("\n\nCustomer %s pays [%s]", "c", "p"))).alias("text"))
    own = textscan.blocks(docs).where("block = 0").select("doc_id", "identity")
    anchors = o.select(F.col("k").alias("anchor_id"), F.col("k").alias("doc_id"), F.format_string("[%s]", "p").alias("exact")).join(own.hint("merge"), "doc_id")
    found = textscan.locate_in_block(docs, anchors)
    return found.select("anchor_id", "hits", (F.col("start") + 1).alias("start"), "error")


@query(f"""with {_ORDERS} select k as target_id, case when k % 2 = 0 then '[' else ' [' end as prefix, ']' as suffix, cast(null as varchar) as error from o""")
def synthesised_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-09, W-06: the smallest contexts that place a price; with another number in brackets before it, the space is needed too."""
    o = _orders(spark, sf_dir)
    text = F.when(F.col("k") % 2 == 0, F.format_string("cost [%s]", "p")).otherwise(F.format_string("[1] [%s].", "p"))
    docs = o.select(F.col("k").alias("doc_id"), text.alias("text"))
    start = F.when(F.col("k") % 2 == 0, 6).otherwise(5)
    targets = o.select(F.col("k").alias("target_id"), F.col("k").alias("doc_id"), start.alias("start"), (start + F.length("p")).alias("end"))
    return textscan.synthesise_anchors(docs, targets)


@query(f"""with {_ORDERS} select k as binding, 'ANCHOR_MISSING' as error, 6 as new_start, 6 + len(p) as new_end from o where k % 3 = 0""")
def anchor_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-21, C-12: bindings whose literal anchor is gone, with the number in the block where they stood."""
    from concordat.plans import review

    o = _orders(spark, sf_dir)
    docs = o.select(F.col("k").alias("doc_id"), F.format_string("Total %s is paid.\n\nCustomer %s.", "p", "c").alias("text"))
    exact = F.when(F.col("k") % 3 == 0, F.format_string("Total of %s is paid", "p")).otherwise(F.format_string("Total %s is paid", "p"))
    anchors = o.select(F.col("k").alias("binding"), F.col("k").alias("doc_id"), exact.alias("exact"))
    own = textscan.blocks(docs).where("block = 0").select("doc_id", "identity")
    previous = o.select(F.col("k").alias("binding"), F.col("k").alias("doc_id"), F.lit(6).alias("offset"), F.lit(6).alias("start"), F.lit(9).alias("end")).join(own.hint("merge"), "doc_id")
    return review.repairs(anchors, docs, previous).select("binding", "error", "new_start", "new_end")


# -- sections, includes, figures --------------------------------------------

_LINES = """l as (select c_nationkey as doc_id, row_number() over (partition by c_nationkey order by c_custkey) + 1 as line, c_custkey as k, c_name as name from customer),
  p as (select l.*, last_value(case when k % 3 = 0 then name end ignore nulls) over (partition by doc_id order by line) as head from l)"""


@query(f"""with {_LINES} select doc_id, cast(line as integer) as line, r_name || ' / ' || n_name || coalesce(' / ' || head, '') as path from p join nation on n_nationkey = doc_id join region on r_regionkey = n_regionkey""")
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-10: customers as lines under their region, nation and every third customer as a heading."""
    from pyspark.sql import Window

    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) + 1
    body = c.select(F.col("c_nationkey").alias("doc_id"), place.alias("line"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("### "), "c_name")).otherwise(F.col("c_name")).alias("text"))
    met = n.join(r, n.n_regionkey == r.r_regionkey)
    heads = met.select(F.col("n_nationkey").alias("doc_id"), F.inline(F.array(F.struct(F.lit(0).alias("line"), F.concat(F.lit("# "), "r_name").alias("text")), F.struct(F.lit(1).alias("line"), F.concat(F.lit("## "), "n_name").alias("text")))))
    return textscan.section_paths(body.unionByName(heads)).where("line > 1")


@query("""select 'c/' || c_custkey || '.tex' as src, 'n' || c_nationkey as target, 'n' || c_nationkey || '.tex' as dst, cast(null as varchar) as error from customer where c_custkey % 4 <> 0
  union all select 'c/' || c_custkey || '.tex', 'own' || c_custkey, null, 'MISSING_INCLUDE' from customer where c_custkey % 4 = 0
  union all select 'n' || n_nationkey || '.tex', 'r' || n_regionkey || '.tex', 'r' || n_regionkey || '.tex', null from nation""")
def include_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-13: includes as written, with the suffix added, or of files that aren't there."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    own = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("own"), "c_custkey")).otherwise(F.concat(F.lit("n"), "c_nationkey"))
    docs = c.select(F.concat(F.lit("c/"), "c_custkey", F.lit(".tex")).alias("file"), F.concat(F.lit("Text. \\input{"), own, F.lit("} more")).alias("text"))
    docs = docs.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey", F.lit(".tex")).alias("file"), F.concat(F.lit("\\include{r"), "n_regionkey", F.lit(".tex}")).alias("text")))
    docs = docs.unionByName(r.select(F.concat(F.lit("r"), "r_regionkey", F.lit(".tex")).alias("file"), F.col("r_name").alias("text")))
    return graphs.resolve_includes(docs)


@query("""select 'p/' || p_partkey || '.tex' as file, 'fig' || p_partkey as target, case when p_partkey % 3 = 1 then 'fig' || p_partkey || '.pdf' when p_partkey % 3 = 2 then 'p/fig' || p_partkey || '.png' end as path,
  case when p_partkey % 3 = 0 and p_partkey % 2 = 0 then 'FIGURE_MISSING' when p_partkey % 3 = 0 then 'FIGURE_AMBIGUOUS' end as error from part""")
def figure_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-13, J-22: graphics by their registered files: beside the document or at the root, in one format, several or none."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    docs = parts.select(F.concat(F.lit("p/"), k, F.lit(".tex")).alias("doc_id"), F.when(k % 2 == 0, F.concat(F.lit("\\includegraphics[width=3cm]{fig"), k, F.lit("}"))).otherwise(F.concat(F.lit("See ![figure](fig"), k, F.lit(").")).alias("text")).alias("text"))
    name = F.concat(F.lit("fig"), k)
    paths = F.when(k % 3 == 1, F.array(F.concat(name, F.lit(".pdf")))).when(k % 3 == 2, F.array(F.concat(F.lit("p/"), name, F.lit(".png")))).when(k % 2 == 1, F.array(F.concat(name, F.lit(".pdf")), F.concat(F.lit("p/"), name, F.lit(".eps"))))
    files = parts.select(F.explode(paths).alias("path"))
    return textscan.resolve_figures(textscan.figure_references(docs).withColumnRenamed("doc_id", "file"), files)


QUERIES, ORACLE_SQL = _r.queries, _r.sql
