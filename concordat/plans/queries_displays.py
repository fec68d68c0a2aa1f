"""Queries on compound displays, roles and dependencies of columns, saved definitions, times and companions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions import lexeme as lx
from concordat.operators import compounds, profile, provenance, textscan
from concordat.operators import metrics as mx
from concordat.operators.scratch import Scratch
from concordat.plans.register import Register
from concordat.plans.vehicles import documents, events, table
from concordat.sources import documents as dc

_r = Register()
query = _r.query

# -- compound displays ----------------------------------------------------

_GROUPS = """rows_ as (select l_returnflag || '/q' || quarter(l_shipdate) as name, cast(l_quantity as double) as q, l_linenumber <= 6 as old from lineitem),
  s as (select name, count(*) as n, avg(q) as m, stddev_samp(q) as sd, count(*) filter (where old) as n0, avg(q) filter (where old) as m0, stddev_samp(q) filter (where old) as sd0 from rows_ group by 1)"""


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, s, s0): exact statistics of quantities by flag and quarter, of all lines and of those that an older report had."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", F.lit("/q"), F.quarter("l_shipdate")).alias("name"), F.col("l_quantity").cast("decimal(18,2)").cast("string").alias("q"), "l_linenumber")
    now, old = (mx.group_statistics(x, ["name"], "q", "0.95").select("name", F.col("statistics").alias(k)) for x, k in ((rows, "s"), (rows.where("l_linenumber <= 6"), "s0")))
    return now.join(old, "name")


def _display(s: str, component: str, **options) -> Column:
    return compounds.render(F.col(s), F.lit("scalar"), component, "decimal", 2, "half_up", **options)


def _compound_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, expected, expected_ci): a sentence for each group with the displays of the older report."""
    shown = _reported(spark, sf_dir).select(F.col("name").alias("doc_id"), _display("s0", "mean_sd", show_n=True).alias("old"), _display("s", "mean_sd", show_n=True).alias("expected"), _display("s0", "mean_ci", spread_places=1).alias("old_ci"), _display("s", "mean_ci", spread_places=1).alias("expected_ci"))
    docs = shown.withColumn("text", F.concat(F.lit("Mode "), "doc_id", F.lit(" reached "), "old", F.lit(", that is "), "old_ci", F.lit(" in 95 % of v1.2.3."))).select("doc_id", "text", "expected", "expected_ci")
    return Scratch(spark, "displays").save(docs, "documents")  # read by several scans


@query(f"""with {_GROUPS}, t as (select *, printf('%.2f \\pm %.2f (n = %d)', m0, sd0, n0) as old, printf('%.2f \\pm %.2f (n = %d)', m, sd, n) as expected from s)
  select name as doc_id, length(name) + 14 as start, length(name) + 14 + length(old) as "end", old as shown, expected, case when old = expected then 'pass' else 'mismatch' end as status from t""")
def compound_displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-18, F-20, F-21, X-19: ``m ± s (n = k)`` found in documents as one span each and compared number by number with the present evidence."""
    docs = _compound_documents(spark, sf_dir)
    found = compounds.spans(docs.select("doc_id", "text"), "mean_sd", show_n=True)
    met = found.join(docs.select("doc_id", "expected"), "doc_id")
    same = compounds.matches(F.col("text"), F.col("expected"), "mean_sd", show_n=True)
    return met.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("text").alias("shown"), "expected", F.when(same, "pass").when(~same, "mismatch").otherwise("unknown").alias("status"))


_T = "(1.959963984540054 + (1.959963984540054^3 + 1.959963984540054) / (4 * (n0 - 1)) + (5 * 1.959963984540054^5 + 16 * 1.959963984540054^3 + 3 * 1.959963984540054) / (96 * (n0 - 1)^2))"


@query(f"""with {_GROUPS}, t as (select name, [round(m0, 2), round(m0 - {_T} * sd0 / sqrt(n0), 1), round(m0 + {_T} * sd0 / sqrt(n0), 1)] as parts from s)
  select name as doc_id, parts[1] as mean, parts[2] as lower, parts[3] as upper from t""")
def compound_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-19, F-13: ``m [lo, hi]`` found in documents and read into its numbers."""
    found = compounds.spans(_compound_documents(spark, sf_dir).select("doc_id", "text"), "mean_ci")
    parts = compounds.parse(F.col("text"), "mean_ci")["parts"]
    # Canonical lexemes have their exponent written out, which a cast reads.
    return found.select("doc_id", *[F.get(parts, F.lit(i)).cast("double").alias(c) for i, c in enumerate(("mean", "lower", "upper"))])


@query(f"""with {_GROUPS}, t as (select name, length(name) + 14 as p0, printf('%.2f', m0) as a, printf('%.2f \\pm %.2f (n = %d)', m0, sd0, n0) as whole from s)
  select name || '/' || k as choice, case when k <> 'mean' then p0 end as start, case when k <> 'mean' then p0 + length(whole) end as "end", case when k = 'mean' then 'NUMERIC_SPAN' end as error,
    case when k = 'all' then 'NUMERIC_SPAN' end as cut from t, (values ('all'), ('mean')) c(k)""")
def compound_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-16, F-22: the display that chosen numbers make up, if they are all of its numbers; and that a span that holds several numbers, or cuts one, is refused as a single number's."""
    docs = _compound_documents(spark, sf_dir).select("doc_id", "text")
    tokens = textscan.number_tokens(docs, native=True)
    displays = compounds.spans(docs, "mean_sd", show_n=True)
    chosen = tokens.where("ord < 3").select(F.concat_ws("/", "doc_id", F.lit("all")).alias("choice"), "doc_id", "start").union(tokens.where("ord = 0").select(F.concat_ws("/", "doc_id", F.lit("mean")), "doc_id", "start"))
    picked = compounds.spans_of_tokens(displays, tokens, chosen)
    located = displays.select(F.concat_ws("/", "doc_id", F.lit("all")).alias("binding"), "doc_id", "start", "end").union(tokens.where("ord = 0").select(F.concat_ws("/", "doc_id", F.lit("mean")), "doc_id", "start", "end"))
    cut = compounds.partial_numbers(docs, located).select(F.col("binding").alias("choice"), F.col("error").alias("cut"))
    return picked.join(cut, "choice", "left").select("choice", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "error", "cut")


@query("""with x as (select s_suppkey, cast(s_acctbal as decimal(18,2)) as v, s_suppkey % 7 - 3 as e from supplier)
  select s_suppkey, cast(v as varchar) || 'E' || e as written, cast(v as double) * pow(10, e) as value from x""")
def scientific_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-15: ``m × 10^e`` in six ways of writing, superscript digits among them."""
    m, e = F.col("s_acctbal").cast("decimal(18,2)").cast("string"), (F.col("s_suppkey") % 7 - 3).cast("string")
    raised = F.translate(e, "0123456789-", "⁰¹²³⁴⁵⁶⁷⁸⁹⁻")
    ways = [F.concat(m, F.lit(" × 10^"), e), F.concat(m, F.lit("x10^{"), e, F.lit("}")), F.concat(m, F.lit(" · 10"), raised), F.concat(m, F.lit("*10^"), e), F.concat(m, F.lit(" × 10"), raised), F.concat(F.lit(" "), m, F.lit(" × 10 ^ "), e, F.lit(" "))]
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.get(F.array(*ways), (F.col("s_suppkey") % 6).cast("int")).alias("shown"))
    written = lx.canonical_scientific("shown")
    return rows.select("s_suppkey", written.alias("written"), written.cast("double").alias("value"))


# -- columns --------------------------------------------------------------


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem under the names that an experiment log would have."""
    names = {"l_orderkey": "experiment_id", "l_linenumber": "seed", "l_returnflag": "model_name", "l_linestatus": "split", "l_quarter": "variant", "l_quantity": "score"}
    rows = table(spark, sf_dir, "lineitem").withColumn("l_quarter", F.concat(F.lit("q"), F.quarter("l_shipdate")))
    return rows.select(*[F.col(c).alias(n) for c, n in names.items()], F.lit("tpc").alias("dataset"))


@query("""select 'experiment_id' as "column", 'group_by' as role, count(distinct l_orderkey) as "distinct" from lineitem union all select 'seed', 'repeat', count(distinct l_linenumber) from lineitem
  union all select 'model_name', case when count(distinct l_returnflag) > 1 then 'group_by' else 'constant' end, count(distinct l_returnflag) from lineitem
  union all select 'split', case when count(distinct l_linestatus) > 1 then 'group_by' else 'constant' end, count(distinct l_linestatus) from lineitem
  union all select 'variant', case when count(distinct quarter(l_shipdate)) > 1 then 'group_by' else 'constant' end, count(distinct quarter(l_shipdate)) from lineitem
  union all select 'score', 'result', count(distinct l_quantity) from lineitem union all select 'dataset', 'constant', 1""")
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-15, C-09: what each column of an experiment log is for."""
    shape = profile.column_profile(_runs(spark, sf_dir))
    return profile.roles(shape).join(shape.select("column", "distinct"), "column")


_LATTICE = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_region"]


def _dependency_sql() -> str:
    """All minimal dependencies by exact distinct counts of every set and of the set with one column more."""
    from itertools import combinations

    def n(columns) -> str:
        return f"(select count(*) from (select distinct {', '.join(columns)} from x))"

    rows = [f"select '{','.join(s)}' as determinant, '{c}' as dependent, {n(s)} = {n((*s, c))} as holds" for k in (1, 2) for s in combinations(_LATTICE, k) for c in _LATTICE if c not in s]
    return f"""with x as (select c_custkey, c_name, c_nationkey, c_mktsegment, n_regionkey as c_region from customer join nation on c_nationkey = n_nationkey), f as ({' union all '.join(rows)}), h as (select * from f where holds)
      select determinant, dependent from h where not exists (select 1 from h b where b.dependent = h.dependent and b.determinant <> h.determinant and list_has_all(string_split(h.determinant, ','), string_split(b.determinant, ',')))"""


@query(_dependency_sql())
def column_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-14, A-15: minimal functional dependencies between customers' columns."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("c_region"))
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(*_LATTICE)
    return profile.dependencies(rows, _LATTICE).select(F.array_join("determinant", ",").alias("determinant"), "dependent")


# -- definitions, times, companions ---------------------------------------


@query("""select c_custkey as definition, c_nationkey as source, c_mktsegment <> 'BUILDING' and c_custkey % 3 <> 1 and c_custkey % 5 <> 2 as matches from customer""")
def experiment_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-27, C-20: definitions saved by customers for their nation's source: some in another format, with another key or with a column of another type."""
    sources = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source"), F.lit("csv").alias("format"), F.array(F.lit("model"), F.lit("seed")).alias("primary_key"), F.create_map(*map(F.lit, ("model", "string", "seed", "integer", "score", "decimal"))).alias("columns"))
    key = F.when(F.col("c_custkey") % 3 == 1, F.array(F.lit("model"))).otherwise(F.array(F.lit("seed"), F.lit("model")))
    kind = F.when(F.col("c_custkey") % 5 == 2, "integer").otherwise("decimal")
    saved = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("definition"), F.col("c_nationkey").alias("source"), F.when(F.col("c_mktsegment") == "BUILDING", "tsv").otherwise("csv").alias("format"), key.alias("primary_key"), F.create_map(F.lit("score"), kind, F.lit("seed"), F.lit("integer")).alias("columns"))
    return provenance.contract_matches(saved, sources)


@query("""select event_id as record, case when event_id % 11 = 3 then 'TIMESTAMP_ZONE' when event_id % 7 = 2 then 'TIMESTAMP_ORDER' end as error from events""")
def zoned_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-38: times of producers, some without a zone, some finished before they started although their local times say otherwise."""
    at = events(spark, sf_dir).select(F.col("event_id").alias("record"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("t"), F.date_format(F.col("at") + F.expr("interval 1 hour"), "yyyy-MM-dd'T'HH:mm:ss").alias("later"))
    started = F.concat("t", F.when(F.col("record") % 7 == 2, "-05:00").otherwise("+02:00"))
    finished = F.concat("later", F.when(F.col("record") % 11 == 3, "").otherwise("+02:00"))
    return provenance.timestamps(at.select("record", started.alias("started"), finished.alias("finished"), F.concat("later", F.lit("Z")).alias("recorded")))


@query("""select 'd' || d.doc_id as file from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)""")
def removable_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-22: documents that no label refers to may be removed."""
    d = documents(spark, sf_dir).select(F.concat(F.lit("d"), "doc_id").alias("file"))
    return dc.companions(d, table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), "doc_id").alias("file")))


QUERIES, ORACLE_SQL = _r.queries, _r.sql
