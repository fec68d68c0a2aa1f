"""Queries on document text: numbers, intervals, anchors, tables and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordat.functions import lexeme as lx
from concordat.operators import intervals, suggest, tables, textscan
from concordat.plans import check as ck
from concordat.plans.register import Register
from concordat.plans.vehicles import documents, table

_r = Register()
query = _r.query

# A grammar that both engines can run: RE2 has no look-behind, so a word character in front is consumed.
_SIMPLE = "[0-9]+"


@query(f"""select doc_id, len(regexp_extract_all(text, '{_SIMPLE}')) as runs from documents where regexp_matches(text, '{_SIMPLE}')""")
def digit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-01 with a grammar both engines share: how many runs of digits a document has, counted over the cut-out tokens."""
    docs = documents(spark, sf_dir).where(F.col("text").rlike(_SIMPLE))
    spans = docs.select("doc_id", F.explode(textscan._spans(F.col("text"), F.lit(_SIMPLE))).alias("s"), "text")
    good = F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")) == F.col("s.text")
    return spans.where(good).groupBy("doc_id").agg(F.count(F.lit(1)).alias("runs"))


@query()
def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-01, W-01, F-31."""
    return textscan.repeats(textscan.number_tokens(documents(spark, sf_dir))).select("doc_id", "ord", "start", "end", "token", "same_text", F.length("before").alias("before"), F.length("after").alias("after"))


@query("""select doc_id, w as word, count(*) as same_text from (select doc_id, unnest(regexp_extract_all(text, '[0-9][0-9.]*')) as w from documents) group by 1, 2 having count(*) > 1""")
def token_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-19."""
    found = documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9][0-9.]*"), F.lit(0))).alias("token"))
    return textscan.repeats(found).where("same_text > 1").select("doc_id", F.col("token").alias("word"), "same_text").distinct()


_SPANS = "spans as (select l_partkey as doc_id, date_diff('day', timestamp '1990-01-01', l_shipdate) as s, date_diff('day', timestamp '1990-01-01', l_shipdate) + cast(l_quantity as integer) as e, l_orderkey as k, l_linenumber as n from lineitem)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.datediff("l_shipdate", F.lit("1990-01-01"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("doc_id"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))


@query(f"with {_SPANS} select a.k as a_k, a.n as a_n, b.k as b_k, b.n as b_n from spans a join spans b on a.doc_id = b.doc_id and a.s < b.e and b.s < a.e and a.s < a.e and b.s < b.e and (a.k, a.n) < (b.k, b.n)")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-05: supplies of one part whose time ranges overlap."""
    spans = _spans(spark, sf_dir)
    other = spans.select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("k").alias("b_k"), F.col("n").alias("b_n"))
    out = intervals.overlap_join(spans.withColumnsRenamed({"k": "a_k", "n": "a_n"}), other, width=64)
    return out.where((F.col("a_k") < F.col("b_k")) | ((F.col("a_k") == F.col("b_k")) & (F.col("a_n") < F.col("b_n")))).select("a_k", "a_n", "b_k", "b_n")


@query(f"with {_SPANS} select doc_id, s as start, e as \"end\" from spans a where n = 1 and not exists (select 1 from spans b where b.n > 1 and a.doc_id = b.doc_id and a.s < b.e and b.s < a.e)")
def unbound_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-06."""
    spans = _spans(spark, sf_dir)
    bound = spans.where("n > 1").select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return intervals.overlap_join(spans.where("n = 1").select("doc_id", "start", "end"), bound, width=64, how="left_anti")


@query(f"with {_SPANS}, p as (select a.doc_id, a.s, a.e, min(b.e - b.s) as width, count(*) as n from spans a join spans b on a.doc_id = b.doc_id and b.s <= a.s and a.e <= b.e and a.s < a.e where a.n = 2 and b.n <> 2 group by 1, 2, 3) select doc_id, s as start, e as \"end\", width from p")
def innermost_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-07, W-12: the width of the shortest range that holds each range."""
    spans = _spans(spark, sf_dir)
    regions = spans.where("n <> 2").select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    one = intervals.innermost(intervals.contained_in(spans.where("n = 2").select("doc_id", "start", "end"), regions, width=64))
    return one.select("doc_id", "start", "end", (F.col("r_end") - F.col("r_start")).alias("width"))


@query(f"""with {_SPANS}, o as (select doc_id, s, e, max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) as before from (select distinct doc_id, s, e from spans)),
  g as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by doc_id order by s, e rows unbounded preceding) as island from o)
  select doc_id, min(s) as start, max(e) as "end" from g group by doc_id, island""")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-11."""
    return intervals.union(_spans(spark, sf_dir).select("doc_id", "start", "end"))


@query("""select c_custkey as left_id, count(s.s_suppkey) as n from customer c left join supplier s on s.s_nationkey = c.c_nationkey and abs(c.c_acctbal - s.s_acctbal) <= 1.2 and abs(c.c_acctbal - s.s_acctbal) <= 2 group by 1""")
def position_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-23: customers and suppliers of a nation as positions on a page."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("page"), *[F.col("c_acctbal").alias(x) for x in ("x0", "x1", "y0", "y1")])
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("page"), *[F.col("s_acctbal").alias(x) for x in ("x0", "x1", "y0", "y1")])
    return intervals.positions_match(c, s).select("left_id", "n")


@query("""select item_id, count(d.doc_id) as documents, coalesce(sum((length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text)), 0) as hits from benchmark b left join documents d on contains(d.text, b.text) group by 1""")
def literal_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-06 for all benchmark items in all documents, items of any length."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("exact"))
    hits = textscan.literals_anywhere(documents(spark, sf_dir), items.withColumnRenamed("item_id", "anchor_id"))
    n = hits.groupBy(F.col("anchor_id").alias("item_id")).agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("hits"))
    return items.select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("hits", F.lit(0)).alias("hits"))


@query("""with w as (select string_split(replace(text, chr(10), ' '), ' ') as w from benchmark), x as (select distinct unnest([w[1], w[1] || ' ' || w[2]]) as exact from w where len(w) > 1),
    l as (select exact from x where length(exact) > 0)
  select exact, sum((length(d.text) - length(replace(d.text, exact, ''))) // length(exact)) as hits from l join documents d on contains(d.text, exact) group by 1""")
def short_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-06 for literals of one and two words: the first of each benchmark item, wherever they stand, also inside words."""
    w = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    firsts = table(spark, sf_dir, "benchmark").where(F.size(w) > 1).select(F.explode(F.array(F.get(w, F.lit(0)), F.concat_ws(" ", F.get(w, F.lit(0)), F.get(w, F.lit(1))))).alias("exact")).distinct()
    hits = textscan.literals_anywhere(documents(spark, sf_dir), firsts.withColumn("anchor_id", F.col("exact")))
    return hits.groupBy(F.col("anchor_id").alias("exact")).agg(F.count(F.lit(1)).alias("hits"))


@query("""select doc_id, len(string_split(text, chr(10))) as lines, strlen(text) as bytes from documents""")
def line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-13, F-34: the line and byte of each document's end."""
    docs = documents(spark, sf_dir)
    out = textscan.line_and_column(docs, docs.select("doc_id", F.length("text").alias("start")))
    return out.select("doc_id", F.col("line").cast("long").alias("lines"), F.col("byte_start").cast("long").alias("bytes"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents where contains(text, '|'))
  select doc_id, count(*) as "rows", sum(len(string_split(line, ' | '))) as cells from l where contains(line, ' | ') group by 1""")
def barred_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-04's cutting of rows into cells, on the corpus's lines with bars."""
    lines = documents(spark, sf_dir).where(F.contains("text", F.lit("|"))).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.contains("line", F.lit(" | ")))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size(F.split("line", r" \| "))).alias("cells"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents where contains(text, ' | ')),
  b as (select doc_id, cast(row_number() over (partition by doc_id order by i) as integer) as "row", trim(string_split(line, ' | ')[1]) as head from l where contains(line, ' | ')),
  bad as (select distinct doc_id from b where contains(head, '|'))
  select doc_id, 0 as table_id, "row", head || ' | [value]' as row_text, 'number' as column_header from b where doc_id not in (select doc_id from bad)""")
def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-04, W-07, X-11 on documents turned into pipe tables: barred lines under a header and a separator, their numbers' places in words."""
    barred = documents(spark, sf_dir).where(F.contains("text", F.lit(" | ")))
    body = F.array_join(F.transform(F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit(" | "))), lambda x: F.concat(F.lit("| "), F.element_at(F.split(x, r" \| "), 1), F.lit(" | "), F.size(F.split(x, r" \| ")), F.lit(" |"))), "\n")
    made = barred.select("doc_id", F.concat(F.lit("Table 1. Parts\n\n| part | number |\n|---|---:|\n"), body).alias("text"))
    return tables.location_context(tables.pipe_cells(made)).where("col = 1").drop("col")


@query("""select n_name as choice, count(*) as locations from nation join customer on n_nationkey = c_nationkey group by 1""")
def suggest_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-08, W-02: table rows that name a nation, for a choice of that nation."""
    n = table(spark, sf_dir, "nation")
    choices = n.select(F.col("n_name").alias("choice"), F.create_map(F.lit("nation"), F.col("n_name")).alias("identity"), F.lit("balance").alias("field"))
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("location"), F.concat(F.lit("row of "), "n_name", F.lit(" in "), "c_mktsegment").alias("row_text"), F.lit("balance").alias("column_header"), F.lit(True).alias("is_table"))
    return suggest.suggest(choices, rows).groupBy("choice").agg(F.count(F.lit(1)).alias("locations"))


@query("""with m as (select n_name as choice, c_custkey as location, cast(c_nationkey = n_nationkey as integer) + cast(c_mktsegment = 'BUILDING' as integer) as matched, cast(c_custkey % 2 = 0 as integer) as field_match, c_custkey % 3 <> 0 as is_table
    from nation join customer on c_nationkey = n_nationkey or c_mktsegment = 'BUILDING'),
  r as (select choice, location, matched, row_number() over (partition by choice order by matched desc, field_match desc, is_table desc, location) as rank, dense_rank() over (partition by choice order by matched desc, field_match desc, is_table desc) as merit from m)
  select *, count(*) filter (where merit = 1) over (partition by choice) as ties from r""")
def suggestion_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-08, W-02, W-03: customers' rows for choices of a nation and one segment, which a fifth of all rows name; every rank and the ties of the best."""
    n = table(spark, sf_dir, "nation")
    choices = n.select(F.col("n_name").alias("choice"), F.create_map(F.lit("nation"), F.col("n_name"), F.lit("segment"), F.lit("BUILDING")).alias("identity"), F.lit("balance").alias("field"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    rows = c.select(k.alias("location"), F.concat(F.lit("row of "), "n_name", F.lit(" in "), "c_mktsegment").alias("row_text"), F.when(k % 2 == 0, "the balance").otherwise("balances").alias("column_header"), (k % 3 != 0).alias("is_table"))
    return suggest.suggest(choices, rows).select("choice", "location", F.size("matched").alias("matched"), "rank", F.col("merit").cast("long").alias("merit"), "ties")


@query("""with r as (select o_custkey, o_orderkey, dense_rank() over w as merit, row_number() over (partition by o_custkey order by o_orderpriority, o_orderkey) as r from orders window w as (partition by o_custkey order by o_orderpriority)),
  t as (select *, count(*) filter (where merit = 1) over (partition by o_custkey) as ties from r) select o_custkey, o_orderkey, ties from t where merit = 1 and r <= 3""")
def best_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-03: the orders that share a customer's most urgent priority, three shown."""
    w = Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy("o_orderpriority", "o_orderkey")).alias("rank"), F.dense_rank().over(w.orderBy("o_orderpriority")).alias("merit"))
    return suggest.best(o.withColumn("ties", F.sum((F.col("merit") == 1).cast("int")).over(w))).select("o_custkey", "o_orderkey", "ties")


@query("""select doc_id, source, (select count(*) from documents) as total, 60 as next_offset from documents order by source, doc_id limit 20 offset 40""")
def paged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-02: the third page of documents by source."""
    from concordat.sources.evidence import page

    return page(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source", "doc_id"], 40, 20).select("doc_id", "source", "total", "next_offset")


@query("""with w as (select lang, doc_id, n_chars, row_number() over (partition by lang order by n_chars desc, doc_id) as place, count(*) over (partition by lang) as total from documents) select lang, doc_id, total, total > 5 as truncated from w where place <= 5""")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-03, T-06: the five longest documents of each language."""
    out = suggest.first_n(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), ["lang"], [F.desc("n_chars"), "doc_id"], 5)
    return out.select("lang", "doc_id", "total", "truncated")


@query("""select doc_id, lower(text) like '%licensed under%' as licensed from documents where lower(text) like '%version%'""")
def candidate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-14, P-15."""
    docs = documents(spark, sf_dir)
    return suggest.search(docs, "version", ["text"]).select("doc_id", F.contains(F.lower("text"), F.lit("licensed under")).alias("licensed"))


@query("""select doc_id, 'sha256:' || sha256(regexp_replace(text, '[0-9]', '#', 'g')) as identity from documents""")
def masked_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-24, F-32 with a mask that both engines share."""
    return documents(spark, sf_dir).select("doc_id", lx.sha256(F.regexp_replace("text", "[0-9]", "#")).alias("identity"))


@query("""select doc_id, case when contains(text, 'Licensed') then replace(text, 'Licensed', 'LICENSED') else text end = text as unchanged, length(text) as n from documents""")
def applied_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-14: every occurrence of a word replaced by offsets; lengths stay, as both words are as long."""
    docs = documents(spark, sf_dir)
    hits = textscan.literal_hits(docs, docs.where(F.contains("text", F.lit("Licensed"))).select(F.col("doc_id").alias("anchor_id"), "doc_id", F.lit("Licensed").alias("exact")))
    out = textscan.apply_patches(docs, hits.select("doc_id", "start", "end", F.lit("Licensed").alias("before"), F.lit("LICENSED").alias("after")))
    return out.join(docs.select("doc_id", F.col("text").alias("old")), "doc_id").select("doc_id", (F.col("text") == F.col("old")).alias("unchanged"), F.length("text").cast("long").alias("n"))


@query()
def text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-04: numbers of all documents: those in license lines are excluded, those with a point are bound."""
    docs = documents(spark, sf_dir)
    tokens = textscan.number_tokens(docs)
    bound = tokens.where(F.contains("token", F.lit("."))).select("doc_id", "start", "end")
    spans = textscan.literal_hits(docs, docs.where(F.contains("text", F.lit("version 3"))).select(F.col("doc_id").alias("anchor_id"), "doc_id", F.lit("version 3").alias("exact"))).select("doc_id", "start", "end")
    marked = ck.context_hash(docs, spans.withColumn("ord", F.xxhash64("doc_id", "start"))).withColumnRenamed("context", "context_hash")
    return ck.coverage(docs, bound, marked).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


QUERIES, ORACLE_SQL = _r.queries, _r.sql
