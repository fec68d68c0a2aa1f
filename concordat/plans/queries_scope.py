"""Queries on what a review covers and on the provenance of figures, notebooks, Quarto documents and fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions import lexeme as lx
from concordat.operators import provenance
from concordat.plans import check as ck
from concordat.plans import scope
from concordat.plans.register import Register
from concordat.plans.vehicles import table
from concordat.sources import sinks

_r = Register()
query = _r.query


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).distinct()


_LINES = "l as (select distinct l_orderkey as k, l_linenumber as n from lineitem)"

# -- provenance -----------------------------------------------------------


@query(f"""with {_LINES}, i as (select k, count(*) filter (where (k * 7 + n) % 31 = 0) as gone, string_agg('l' || k || '-' || n, ',' order by 'l' || k || '-' || n) filter (where (k + n) % 23 = 0 and (k * 7 + n) % 31 <> 0) as moved from l group by k),
  f as (select o_orderkey as k, case when o_orderkey % 37 = 0 then 'FILE_UNAVAILABLE' when o_orderstatus = 'P' then 'PROVENANCE_UNKNOWN' when o_custkey % 50 = 0 then 'FIGURE_RECORD' when gone > 0 then 'FILE_UNAVAILABLE' end as e,
    moved, case when o_orderkey % 11 = 0 then 'fig' || o_orderkey end as edited from orders left join i on k = o_orderkey)
  select k as figure, case when e is not null then 'unknown' when coalesce(moved, edited) is not null then 'mismatch' else 'pass' end as status, coalesce(e, case when coalesce(moved, edited) is not null then 'FIGURE_CHANGED' end) as error,
    case when e is null then concat_ws(',', moved, edited) else '' end as changed_paths from f""")
def figure_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-11, C-14: orders as figures, their lines as recorded inputs; some lines changed or gone, some figures edited, gone, unrecorded or recorded under another path."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    path, k = _text("fig", F.col("k")), F.col("k")
    figures = o.select(k.alias("figure"), path.alias("path"), F.when(F.col("o_orderstatus") != "P", _text("r", k)).alias("record"))
    records = o.where("o_orderstatus <> 'P'").select(_text("r", k).alias("record"), F.when(F.col("o_custkey") % 50 == 0, "elsewhere").otherwise(path).alias("path"), F.when(k % 11 == 0, "before").otherwise("now").alias("output_hash"))
    lines = _lines(spark, sf_dir).withColumn("path", _text("l", k, "-", F.col("n")))
    inputs = lines.select(_text("r", k).alias("record"), "path", F.lit("v").alias("recorded"))
    state = F.when((k * 7 + F.col("n")) % 31 == 0, "unavailable:FILE_UNAVAILABLE").when((k + F.col("n")) % 23 == 0, "w").otherwise("v")
    current = lines.select("path", state.alias("identity")).unionByName(o.where("k % 37 <> 0").select(path.alias("path"), F.lit("now").alias("identity")))
    out = provenance.figure_states(figures, records, inputs, current)
    return out.select("figure", "status", "error", F.array_join("changed_paths", ",").alias("changed_paths"))


@query(f"""with {_LINES}, c as (select k, count(*) as n, count(*) filter (where (k + n) % 43 = 0) as lost, count(*) filter (where (k + n) % 43 <> 0 and (k * 3 + n) % 13 = 0) as differ, count(*) filter (where (k + n) % 43 <> 0 and (k + n) % 19 = 0) as loose from l where k % 2 = 0 group by k),
  p as (select o_orderkey as k, case when o_orderkey % 2 = 0 then 'notebook' else 'quarto' end as kind, coalesce(n, 0) as n, coalesce(lost, 0) as lost, coalesce(differ, 0) as differ, coalesce(loose, 0) as loose, o_custkey % 29 = 0 as gone,
    case when o_custkey % 17 = 0 and o_custkey % 29 <> 0 then 'c' || o_custkey end as a, case when o_orderkey % 9 = 0 then 's' || o_orderkey || case when o_orderkey % 41 = 0 then '.txt' when o_orderkey % 2 = 0 then '.ipynb' else '.qmd' end end as b from orders left join c on k = o_orderkey),
  s as (select *, case when k % 41 = 0 or (kind = 'notebook') <> (n > 0) then 'PROVENANCE_SPEC' when gone then 'FILE_UNAVAILABLE' when lost > 0 then 'PROVENANCE_CELLS' when loose > 0 then 'NOTEBOOK_OUTPUT_UNVERIFIED' when coalesce(a, b) is not null or differ > 0 then 'PRODUCER_STALE' end as error from p)
  select k as record, kind, case when error = 'PRODUCER_STALE' then 'mismatch' when error is not null then 'unknown' else 'pass' end as status, error, concat_ws(',', a, b) as changed_paths, differ as changed_cells, loose as unverified_cells from s""")
def producer_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-12, C-14: even orders as notebooks with their lines as cells, odd ones as Quarto documents, customers as inputs that many share."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    k, c, n = F.col("k"), F.col("c"), F.col("n")
    even = k % 2 == 0
    source = _text("s", k, F.when(k % 41 == 0, ".txt").when(even, ".ipynb").otherwise(".qmd"))
    specs = o.select(k.alias("record"), F.when(even, "notebook").otherwise("quarto").alias("kind"), source.alias("source"))
    paths = o.select(k.alias("record"), F.explode(F.array(source, _text("c", c))).alias("path"), F.lit("v").alias("recorded"))
    customers = o.where("c % 29 <> 0").select("c").distinct().select(_text("c", c).alias("path"), F.when(c % 17 == 0, "w").otherwise("v").alias("identity"))
    current = o.select(source.alias("path"), F.when(k % 9 == 0, "w").otherwise("v").alias("identity")).unionByName(customers)
    lines = _lines(spark, sf_dir).where(even)
    same = {"cell_id": n.cast("string"), "source_hash": F.lit("s"), "execution_count": n.cast("long")}
    cells = lines.select(k.alias("record"), F.lit("o").alias("outputs_hash"), *[v.alias(x) for x, v in same.items()])
    status = F.when((k + n) % 19 == 0, "unexecuted").otherwise("saved_outputs")
    scanned = lines.where((k + n) % 43 != 0).select(source.alias("path"), F.when((k * 3 + n) % 13 == 0, "new").otherwise("o").alias("outputs_hash"), status.alias("status"), *[v.alias(x) for x, v in same.items()])
    out = provenance.producer_states(specs, paths, cells, current, scanned)
    return out.select("record", "kind", "status", "error", F.array_join("changed_paths", ",").alias("changed_paths"), F.size("changed_cells").cast("long").alias("changed_cells"), F.size("unverified_cells").cast("long").alias("unverified_cells"))


_FRAGMENTS = r"""v as (select o_custkey as c, o_orderkey as k, cast(cast(o_totalprice as decimal(18,2)) as varchar) || case when o_orderkey % 3 = 0 then ' \pm 1' else '' end as r from orders),
  w as (select c, k, case when c % 2 = 1 then replace(r, '\pm', '±') when contains(r, '\pm') then '\ensuremath{' || r || '}' else r end as r from v),
  b as (select c, count(*) as n, string_agg(case when c % 10 = 9 then r || chr(10) when c % 2 = 0 then 'o\_' || k || ' & ' || r || ' \\' || chr(10) else '| o\_' || k || ' | ' || r || ' |' || chr(10) end, '' order by k) as body from w group by c),
  t as (select c_custkey as c, c_nationkey, n, 'f' || c_custkey || case when c_custkey % 23 = 0 then '.txt' when c_custkey % 2 = 0 then '.tex' else '.md' end as path, case when n is null or (c_custkey % 10 = 9 and n <> 1) then 'FRAGMENT_SELECTION' when c_custkey % 23 = 0 then 'FRAGMENT_EXTENSION' end as error,
    case when c_custkey % 10 = 9 then body when c_custkey % 2 = 0 then '\begin{tabular}{lr}' || chr(10) || h || ' & ' || g || ' \\' || chr(10) || body || '\end{tabular}' || chr(10) else '| ' || h || ' | ' || g || ' |' || chr(10) || '| --- | ---: |' || chr(10) || body end as text
    from (select *, case when c_custkey % 4 >= 2 then '绑定' else 'Binding' end as h, case when c_custkey % 4 >= 2 then '数值' else 'Value' end as g from customer) left join b on c = c_custkey)"""


def _fragments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as fragments, their orders as bound values."""
    k = F.col("c_custkey")
    latex = k % 2 == 0
    suffix = F.when(k % 23 == 0, ".txt").when(latex, ".tex").otherwise(".md")
    specs = table(spark, sf_dir, "customer").select(
        k.alias("fragment"), F.when(latex, "latex").otherwise("markdown").alias("format"), F.when(k % 10 == 9, "value").otherwise("table").alias("layout"), F.when(k % 4 >= 2, "zh-CN").otherwise("en").alias("language"), _text("f", k, suffix).alias("path"), "c_nationkey"
    )
    o = table(spark, sf_dir, "orders")
    shown = F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, " \\pm 1").otherwise(""))
    return specs, o.select(F.col("o_custkey").alias("fragment"), F.col("o_orderkey").alias("ord"), _text("o_", F.col("o_orderkey")).alias("occurrence"), shown.alias("rendered"))


@query(f"with {_FRAGMENTS} select c as fragment, case when error is null then text end as text, error from t")
def fragment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-20, C-27: whole fragments as tables and single values in both formats and languages."""
    return sinks.fragment_texts(*_fragments(spark, sf_dir))


@query(f"""with {_FRAGMENTS}, s as (select c, path, n, case when error is null then 'sha256:' || sha256(text) end as content, c % 31 = 0 as miss, c_nationkey from t),
  u as (select *, case when content is null or c % 7 = 0 then 'old' else content end as was, case when content is null or c % 11 = 0 then 'edited' else content end as actual from s),
  x as (select *, case when miss then 'FILE_UNAVAILABLE' when content is null then 'FRAGMENT_SELECTION' end as lost, concat_ws(',', case when c % 29 = 0 then 'gone' end, case when c % 17 = 0 then 'n' || c_nationkey end, case when was <> actual then path end) as moved from u),
  y as (select *, lost is null and c % 13 = 0 as contract_changed, lost is null and c % 19 = 0 as values_changed, lost is null and (was <> actual or actual <> content) as output_changed from x)
  select c as fragment, case when lost is not null then 'unknown' when moved <> '' or contract_changed or values_changed or output_changed then 'mismatch' else 'pass' end as status,
    coalesce(lost, case when moved <> '' or contract_changed or values_changed or output_changed then 'FRAGMENT_STALE' end) as error, case when lost is null then moved else '' end as changed_paths, contract_changed, values_changed, output_changed from y""")
def fragment_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-19, C-14: fragments rendered again, against what was recorded of inputs, declarations, values and the file."""
    specs, values = _fragments(spark, sf_dir)
    f = F.col("fragment")
    texts = sinks.fragment_texts(specs, values).where("error is null").select("fragment", lx.sha256("text").alias("content_hash"))
    n = values.groupBy("fragment").agg(F.concat(F.lit("h"), F.count(F.lit(1)).cast("string")).alias("values_hash"))
    rendered = texts.join(n, "fragment").select("fragment", F.when(f % 13 == 0, "v2").otherwise("v1").alias("contract"), F.when(f % 19 == 0, "new").otherwise(F.col("values_hash")).alias("values_hash"), "content_hash")
    base = specs.select("fragment", "path", "c_nationkey").join(texts, "fragment", "left").join(n, "fragment", "left")
    content = F.coalesce("content_hash", F.lit("none"))
    records = base.select("fragment", "path", F.lit("v1").alias("contract"), "values_hash", F.when((content == "none") | (f % 7 == 0), "old").otherwise(content).alias("output_hash"))
    current = base.where("fragment % 31 <> 0").select("path", F.when((content == "none") | (f % 11 == 0), "edited").otherwise(content).alias("identity"))
    nation = _text("n", F.col("c_nationkey"))
    recorded = specs.select("fragment", nation.alias("path"), F.lit("v").alias("recorded")).unionByName(specs.where("fragment % 29 = 0").select("fragment", F.lit("gone").alias("path"), F.lit("v").alias("recorded")))
    inputs = specs.select("fragment", nation.alias("path"), F.when(f % 17 == 0, "w").otherwise("v").alias("identity"))
    out = provenance.fragment_states(records, recorded, rendered, inputs, current)
    return out.select("fragment", "status", "error", F.array_join("changed_paths", ",").alias("changed_paths"), "contract_changed", "values_changed", "output_changed")


# -- scope and exclusions -------------------------------------------------


@query("""with t as (select o_orderkey as k, unnest([1, 2, 3, 4]) as i from orders), s as (select k, case when i = 1 then 'bound' when i = 2 and k % 3 = 0 and k % 9 <> 0 then 'excluded' when i = 2 and k % 2 = 0 and k % 4 <> 0 then 'unbound' else 'outside_scope' end as state from t)
  select k as doc_id, state, count(*) as n from s group by 1, 2""")
def scope_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-04, C-24, P-13: even orders' abstracts under review; in each the first number is bound, the second sometimes excluded, by a context that in part has changed."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").cast("string").alias("c"), F.year("o_orderdate").alias("y"))
    k = F.col("doc_id")
    plain = k % 4 == 0
    head = F.when(plain, "Gain ").otherwise("\\begin{abstract}Gain ")
    first, mid = F.concat(head, F.col("c")), F.lit(" and ")
    tail = F.when(plain, ".").otherwise(".\\end{abstract}")
    docs = o.select("doc_id", _text(first, mid, k, tail, "\nLater ", F.col("c"), " of ", F.col("y"), ".").alias("text"))
    at = o.select("doc_id", F.length(head).alias("s1"), F.length(first).alias("e1"), (F.length(first) + 5).alias("s2"), F.length(k.cast("string")).alias("len"))
    bound = at.select("doc_id", F.col("s1").alias("start"), F.col("e1").alias("end"))
    spans = at.where("doc_id % 3 = 0").select(k.alias("ord"), "doc_id", F.col("s2").alias("start"), (F.col("s2") + F.col("len")).alias("end"))
    marked = ck.context_hash(docs, spans).withColumn("context_hash", F.when(k % 9 == 0, "changed").otherwise(F.col("context"))).drop("context")
    out = ck.coverage(docs, bound, marked, o.where("doc_id % 2 = 0").select("doc_id"), ("abstract",))
    return out.groupBy("doc_id", "state").agg(F.count(F.lit(1)).alias("n"))


@query("""with l as (select distinct l_orderkey as k, l_linenumber as n, (l_orderkey + l_linenumber) % 4 = 0 as stale, l_orderkey % 5 = 0 and l_linenumber = 1 as is_bound from lineitem),
  e as (select k, n, n - row_number() over (partition by k order by n) as island from l where not stale and not is_bound), a as (select k, n, row_number() over (partition by k, island order by n) % 2 = 1 as active from e)
  select l.k * 10 + l.n as ord, case when is_bound then 'EXCLUSION_BOUND' when p.active then 'EXCLUSION_OVERLAP' when stale then 'EXCLUSION_CHANGED' end as error from l left join a p on p.k = l.k and p.n = l.n - 1""")
def exclusion_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-20, C-24: chains of exclusions, each overlapping the next; every second one of a chain yields, and those that yielded stop nobody."""
    lines = _lines(spark, sf_dir)
    k, n = F.col("k"), F.col("n")
    docs = lines.select(k.alias("doc_id")).distinct().select("doc_id", F.repeat(_text("Line ", F.col("doc_id"), ". "), 20).alias("text"))
    spans = lines.select((k * 10 + n).alias("ord"), k.alias("doc_id"), (n * 10).alias("start"), (n * 10 + 15).alias("end"), ((k + n) % 4 == 0).alias("stale"))
    marked = ck.context_hash(docs, spans).withColumn("context_hash", F.when(F.col("stale"), "changed").otherwise(F.col("context"))).drop("context", "stale")
    bound = docs.where("doc_id % 5 = 0").select("doc_id", F.lit(12).alias("start"), F.lit(14).alias("end"))
    return ck.active_exclusions(docs, bound, marked).select("ord", "error")


@query("""with o as (select o_orderkey as k, o_orderkey % 7 as m, o_orderkey % 5 = 0 as d, o_orderkey % 11 = 0 as b from orders)
  select 'x' || k as name, case when b then 'inactive' else 'active' end as state from o where d and m <> 1
  union all select case when m = 4 then 'y' else 'x' end || k, case when m = 3 then 'SCOPE_ACTION' when m in (0, 2) and d then 'EXCLUSION_EXISTS' when m = 0 and k % 21 = 0 then 'EXCLUSION_SCHEMA' when m = 2 then 'BUILDER_SELECTION' when m = 1 then 'EXCLUSION_MISSING' when b or (m = 4 and d) then 'EXCLUSION_INVALID' else 'active' end
    from o where m <= 4 and not (m = 1 and d)""")
def exclusion_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-24: exclusions asked for and withdrawn in every order's text, next to declared ones; a new one has to be active afterwards."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("c"))
    k = F.col("doc_id")
    docs = o.select("doc_id", _text("Order ", k, " by ", F.col("c"), ".").alias("text"))
    spans = o.select("doc_id", F.lit(6).alias("start"), (F.length(k.cast("string")) + 6).alias("end"))
    bound = spans.where("doc_id % 11 = 0")
    named = spans.where("doc_id % 5 = 0").select(_text("x", k).alias("name"), k.alias("ord"), "doc_id", "start", "end", F.lit("not a result").alias("reason"))
    declared = ck.context_hash(docs, named).withColumnRenamed("context", "context_hash")
    m = k % 7
    action = F.when(m == 1, "remove").when(m == 3, "drop").otherwise("exclude")
    requests = spans.where(m <= 4).select(_text(F.when(m == 4, "y").otherwise("x"), k).alias("name"), k.alias("ord"), action.alias("action"), "doc_id", (F.col("start") + F.when(m == 2, 1).otherwise(0)).alias("start"), "end", F.when(k % 21 == 0, " ").otherwise("a year").alias("reason"))
    after, refused = scope.change_exclusions(docs, bound, declared, requests)
    return after.select("name", F.when(F.col("active"), "active").otherwise("inactive").alias("state")).unionByName(refused.select("name", F.col("error").alias("state")))


QUERIES, ORACLE_SQL = _r.queries, _r.sql
