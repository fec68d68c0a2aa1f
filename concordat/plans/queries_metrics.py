"""Queries on evidence: gates, metrics, derived values, displays, claims and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordat.functions import exact
from concordat.functions import lexeme as lx
from concordat.operators import metrics as mx
from concordat.operators import profile, states
from concordat.operators.declared import declared
from concordat.operators.metrics import Derived, Metric
from concordat.plans.check import check
from concordat.plans.register import Register
from concordat.plans.vehicles import TYPES, evidence, events, table
from concordat.sources import evidence as ev

_r = Register()
query = _r.query
GROUPS = [(m, s) for m in ("A", "N", "R") for s in ("F", "O")]

_EVIDENCE = """evidence as (select l_returnflag as model, l_linestatus as split, l_linenumber as seed, l_orderkey as order_key,
  cast(l_discount as decimal(18,2)) as discount, cast(l_quantity as decimal(18,2)) as quantity from lineitem)"""
_PAIRS = "groups as (select * from (values ('A','F'),('A','O'),('N','F'),('N','O'),('R','F'),('R','O')) g(model, split))"


def _named(how: str, field: str, unit: str = "scalar", **options) -> list[Metric]:
    return [Metric(f"{how}_{m}_{s}", field, how, unit, {"model": m, "split": s}, **options) for m, s in GROUPS]


def _shown(results: DataFrame) -> DataFrame:
    return results.select("metric", F.round(F.col("value").cast("double"), 6).alias("value"), "error", "n")


# -- gates ----------------------------------------------------------------


@query("""select event_id, case when x not similar to '[+-]?(0|[1-9][0-9]*)' then 'COLUMN_TYPE' end as integer_error,
  case when x similar to '[+-]?(0|[1-9][0-9]*)' then cast(x as bigint) end as integer_value from
  (select event_id, coalesce(nullif(regexp_extract(props, '"k": *([^,}]*)', 1), ''), '-') as x from events)""")
def typed_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "events").select("event_id", F.coalesce(F.nullif(F.regexp_extract("props", '"k": *([^,}]*)', 1), F.lit("")), F.lit("-")).alias("x"))
    gate = lx.typed_gate("x", "integer")
    return cells.select("event_id", gate["error"].alias("integer_error"), gate["value"].cast("long").alias("integer_value"))


@query("""select event_id, case when value is null then 'INVALID_NUMBER' end as error,
  cast(value as double) as value from events""")
def decimal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "events").select("event_id", F.col("value").cast("string").alias("x"))
    gate = lx.decimal_gate("x")
    return cells.select("event_id", gate["error"].alias("error"), gate["value"].cast("double").alias("value"))


@query("""with bad as (select event_type as source, min(event_id) as line from events where event_id % 997 = 5 group by 1)
  select e.source, case when b.source is not null then 'COLUMN_TYPE' end as error, b.line, e.n from
  (select event_type as source, count(*) as n from events group by 1) e left join bad b using (source)""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with an x in front fail their source; the first of them is named."""
    cells = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("line"), F.when(F.col("event_id") % 997 == 5, F.concat(F.lit("x"), F.col("event_id"))).otherwise(F.col("event_id").cast("string")).alias("cell"))
    gated = cells.select("source", "line", lx.typed_gate("cell", "integer")["error"].alias("error"))
    bad = mx.source_health(gated)
    first = gated.where("error is not null").groupBy("source").agg(F.min("line").alias("line"))
    return cells.groupBy("source").agg(F.count(F.lit(1)).alias("n")).join(bad, "source", "left").join(first, "source", "left").select("source", "error", "line", "n")


@query(f"with {_EVIDENCE} select order_key, seed, cast(discount as varchar) as discount from evidence where model = 'R' and split = 'F'")
def selector_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence(spark, sf_dir).where((F.col("model") == "R") & (F.col("split") == "F"))
    return rows.select(F.col("order_key").cast("long").alias("order_key"), F.col("seed").cast("int").alias("seed"), "discount")


# -- reductions -----------------------------------------------------------


def _sql_metric(how: str, value: str, error: str = "null") -> str:
    return f"""with {_EVIDENCE}, {_PAIRS}, r as (select g.model, g.split, count(e.seed) as n, sum(discount) as total, count(discount) as held from groups g left join evidence e using (model, split) group by 1, 2)
      select '{how}_' || model || '_' || split as metric, case when n > 0 and ({error}) is null then {value} end as value,
      case when n = 0 then 'EMPTY_SELECTION' else {error} end as error, n from r"""


@query(_sql_metric("mean", "round(cast(total as double) / n, 6)"))
def metric_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(mx.evaluate(evidence(spark, sf_dir), _named("mean", "discount", "fraction"), TYPES, fingerprints=False))


@query(_sql_metric("sum", "round(cast(total as double), 6)"))
def metric_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(mx.evaluate(evidence(spark, sf_dir), _named("sum", "discount"), TYPES, fingerprints=False))


@query(_sql_metric("count", "cast(n as double)"))
def metric_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(mx.evaluate(evidence(spark, sf_dir), _named("count", "discount", "count"), TYPES, fingerprints=False))


@query(f"""with {_EVIDENCE}, r as (select order_key, count(*) as n, min(quantity) as value from evidence group by 1)
  select order_key, n, case when n = 1 then cast(value as double) end as value, case when n > 1 then 'AMBIGUOUS_SELECTION' end as error from r""")
def metric_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-01 for every order as a declared selection of its own."""
    out = mx.batch_matrix(evidence(spark, sf_dir), ["order_key"], ["quantity"], how="unique")
    return out.select(F.col("order_key").cast("long").alias("order_key"), "n", F.col("value").cast("double").alias("value"), "error")


@query(f"""with {_EVIDENCE}, {_PAIRS}, r as (select g.model, g.split, count(e.seed) as n, avg(cast(quantity as double)) as mean, stddev_samp(cast(quantity as double)) as sd
    from groups g left join evidence e using (model, split) group by 1, 2)
  select 'statistics_' || model || '_' || split as metric, case when n > 1 then round(mean, 6) end as mean, case when n > 1 then round(sd, 6) end as sd,
  case when n > 1 then round(sd / sqrt(n), 6) end as se, case when n = 0 then 'EMPTY_SELECTION' when n = 1 then 'STATISTICS_COUNT' end as error, n from r""")
def metric_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact moments of all rows."""
    out = mx.evaluate(evidence(spark, sf_dir), _named("statistics", "quantity", level="0.95"), TYPES, fingerprints=False)
    return out.select("metric", *[F.round(F.col(f"statistics.{c}").cast("double"), 6).alias(c) for c in ("mean", "sd", "se")], "error", "n")


@query(f"""with {_EVIDENCE} select model, split, count(*) as n, round(avg(cast(quantity as double)), 6) as mean, round(stddev_samp(cast(quantity as double)), 6) as sd,
  round(avg(cast(quantity as double)) - 1.959963984540054 * stddev_samp(cast(quantity as double)) / sqrt(count(*)), 4) as lower from evidence group by 1, 2""")
def statistics_fast_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-05 over all rows; the bound takes the normal quantile."""
    out = mx.group_statistics(evidence(spark, sf_dir), ["model", "split"], "quantity").select("model", "split", *[F.col(f"statistics.{c}").cast("double").alias(c) for c in ("mean", "sd", "se")], F.col("statistics.n").alias("n"))
    return out.select("model", "split", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(F.col("mean") - 1.959963984540054 * F.col("se"), 4).alias("lower"))


@query(f"""with {_EVIDENCE}, r as (select order_key, count(*) as n, list_sort(list(seed)) = [1, 2, 3] as whole, sum(quantity) as total from evidence group by 1)
  select order_key, n, case when not whole then 'SEED_SET' end as error, case when whole then round(cast(total as double) / 3, 6) end as value from r""")
def seed_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-07 for every order as an experiment: exactly the seeds 1, 2 and 3, each once."""
    out = mx.batch_matrix(evidence(spark, sf_dir), ["order_key"], ["quantity"], seed="seed", expected_seeds=["1", "2", "3"])
    return out.select(F.col("order_key").cast("long").alias("order_key"), "n", "error", F.round(F.col("value").cast("double"), 6).alias("value"))


@query(f"""with {_EVIDENCE} select model, split, field, count(*) as n, round(cast(sum(x) as double) / count(*), 6) as value, cast(null as varchar) as error
  from (unpivot (select model, split, discount, quantity from evidence) on discount, quantity into name field value x) group by 1, 2, 3""")
def batch_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.batch_matrix(evidence(spark, sf_dir), ["model", "split"], ["discount", "quantity"]).select("model", "split", "field", "n", F.round(F.col("value").cast("double"), 6).alias("value"), "error")


_WIDE = "case l_linenumber % 3 when 0 then '' when 1 then '00000000000' else '0000000000000000000000' end"


@query(f"""with x as (select l_returnflag as model, l_orderkey % 100 as bucket, cast(cast(cast(l_extendedprice as decimal(18,2)) * 100 as bigint)::varchar || {_WIDE} as decimal(38,0)) as v, cast(l_linenumber as varchar) as seed from lineitem)
  select model, bucket, 'value' as field, count(*) as n, cast(sum(v) as varchar) as value from x group by 1, 2""")
def batch_wide_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-10 and A-03 with numbers of up to 34 digits, most of them beyond DECIMAL(24,12): exact sums, no rounding anywhere."""
    cents = (F.col("l_extendedprice").cast("decimal(18,2)") * 100).cast("long").cast("string")
    zeros = F.element_at(F.array(*[F.repeat(F.lit("0"), F.lit(n)) for n in (0, 11, 22)]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), (F.col("l_orderkey") % 100).alias("bucket"), F.concat(cents, zeros).alias("value"))
    return mx.batch_matrix(rows, ["model", "bucket"], ["value"], how="sum").select("model", "bucket", "field", "n", "value")


# Printed two-sided 95 % quantiles of Student's t for 1 to 30 degrees of freedom.
_STUDENT = "(1, 12.7062047361747), (2, 4.3026527297495), (3, 3.1824463052837), (4, 2.7764451051978), (5, 2.5705818356363), (6, 2.4469118511450), (7, 2.3646242515928), (8, 2.3060041352042), (9, 2.2621571627982), (10, 2.2281388519863), (11, 2.2009851600916), (12, 2.1788128296672), (13, 2.1603686564628), (14, 2.1447866879178), (15, 2.1314495455598), (16, 2.1199052992213), (17, 2.1098155778333), (18, 2.1009220402410), (19, 2.0930240544083), (20, 2.0859634472659), (21, 2.0796138447277), (22, 2.0738730679040), (23, 2.0686576104190), (24, 2.0638985616280), (25, 2.0595385527533), (26, 2.0555294386429), (27, 2.0518305164803), (28, 2.0484071417952), (29, 2.0452296421327), (30, 2.0422724563012)"


@query(f"""with {_EVIDENCE}, t as (select * from (values {_STUDENT}) t(df, q)),
  r as (select order_key, count(*) as n, avg(cast(quantity as double)) as mean, stddev_samp(cast(quantity as double)) / sqrt(count(*)) as se from evidence group by 1)
  select order_key, n, round(mean, 6) as mean, round(mean - q * se, 4) + 0.0 as lower, round(mean + q * se, 4) as upper, cast(null as varchar) as error from r join t on df = n - 1
  union all select order_key, n, null, null, null, 'STATISTICS_COUNT' from r where n = 1""")
def confidence_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-13, F-14: Student bounds of every order's mean quantity."""
    out = mx.group_statistics(evidence(spark, sf_dir), ["order_key"], "quantity", "0.95")
    shown = [F.round(F.col(f"statistics.{c}").cast("double"), k).alias(c) for c, k in (("mean", 6), ("lower", 4), ("upper", 4))]
    return out.select(F.col("order_key").cast("long").alias("order_key"), "n", *shown, "error").withColumn("lower", F.col("lower") + 0.0)


@query(f"""with {_EVIDENCE} select model, count(*) as n, count(distinct order_key) as experiments from evidence group by 1""")
def experiment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-09: the groups that a batch makes of the orders, counted by model."""
    groups = mx.batch_matrix(evidence(spark, sf_dir), ["model", "order_key"], ["discount"], how="count")
    return groups.groupBy("model").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("experiments"))


@query("""with c as (select l_returnflag as model, l_linestatus as split, count(*) as n, count(*) filter (where l_orderkey % 7 = 1) as changed from lineitem group by 1, 2)
  select 'sum_' || model || '_' || split as metric, n, true as reordered_same, changed = 0 as edited_same from c""")
def fingerprint_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-11: reordered evidence gives the same fingerprints; evidence with some values edited gives others wherever a selected row was edited."""
    rows = evidence(spark, sf_dir)
    wanted = _named("sum", "discount")
    edited = rows.withColumn("discount", F.when(F.col("order_key").cast("long") % 7 == 1, F.concat("discount", F.lit("1"))).otherwise(F.col("discount")))
    a, b, c = (mx.evaluate(x, wanted, TYPES).select("metric", "n", F.col("fingerprint").alias(k)) for k, x in (("a", rows), ("b", rows.repartition(7, "quantity")), ("c", edited)))
    met = a.where("a is not null").join(b.drop("n"), "metric").join(c.drop("n"), "metric")
    return met.select("metric", "n", (F.col("a") == F.col("b")).alias("reordered_same"), (F.col("a") == F.col("c")).alias("edited_same"))


# -- derived values and displays ------------------------------------------


@query(f"""with {_EVIDENCE}, m as (select model, cast(sum(discount) as double) / count(*) as v from evidence group by 1)
  select 'pp_' || a.model || '_' || b.model as metric, round((a.v - b.v) * 100, 6) as value, 'percentage_point' as unit, cast(null as varchar) as error from m a join m b on a.model < b.model
  union all select 'ratio_' || a.model || '_' || b.model, round(a.v / b.v, 6), 'ratio', null from m a join m b on a.model < b.model
  union all select 'change_' || a.model || '_' || b.model, round((a.v - b.v) / b.v * 100, 6), 'percent', null from m a join m b on a.model < b.model
  union all select 'level2', round((select v from m where model = 'A') / (select v from m where model = 'N') - (select v from m where model = 'A') / (select v from m where model = 'R'), 6), 'ratio', null""".replace("select 'pp_'", "select 2 as sources, 'pp_'", 1).replace("select 'ratio_'", "select 2, 'ratio_'").replace("select 'change_'", "select 2, 'change_'").replace("select 'level2'", "select 3, 'level2'"))
def derived_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-03 with F-06 to F-09, A-12 and U-05: also a second level, and of how many source metrics the evidence is."""
    own = mx.evaluate(evidence(spark, sf_dir), [Metric(m, "discount", "mean", "fraction", {"model": m}) for m in "ANR"], TYPES, fingerprints=False)
    pairs = [("A", "N"), ("A", "R"), ("N", "R")]
    ops = {"pp": "percentage_point_difference", "ratio": "ratio", "change": "relative_change_percent"}
    out = mx.derive(own, [*[Derived(f"{k}_{a}_{b}", op, a, b) for a, b in pairs for k, op in ops.items()], Derived("level2", "difference", "ratio_A_N", "ratio_A_R")])
    return out.where("size(dependencies) > 0").select("metric", F.round(F.col("value").cast("double"), 6).alias("value"), "unit", "error", F.size("evidence").alias("sources"))


@query("""select o_orderkey, cast(cast(round(cast(o_totalprice as decimal(18,2)), 1) as decimal(18,1)) as varchar) as half_up, cast(cast(case when abs(cast(o_totalprice as decimal(18,2)) * 100) % 10 = 5
    then (cast(floor(abs(cast(o_totalprice as decimal(18,2)) * 10)) as bigint) + cast(floor(abs(cast(o_totalprice as decimal(18,2)) * 10)) as bigint) % 2) * sign(o_totalprice) / 10 else round(cast(o_totalprice as decimal(18,2)), 1) end as decimal(18,1)) as varchar) as half_even from orders""")
def rendered_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-10 for both roundings."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    shown = {r: lx.render(price, F.lit("scalar"), F.lit("decimal"), F.lit(1), F.lit(r))["text"].alias(r) for r in ("half_up", "half_even")}
    return table(spark, sf_dir, "orders").select("o_orderkey", *shown.values())


@query("""select l_orderkey, l_linenumber, cast(cast(cast(l_discount as decimal(18,2)) * 100 as decimal(18,1)) as varchar) || '\\%' as shown, l_discount = l_tax as matches from lineitem""")
def percent_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-11, F-03, F-04: a discount shown in percent against the tax written in another way: with more places and a spaced percent sign."""
    shown, other = (lx.render(F.col(c).cast("decimal(18,2)"), F.lit("fraction"), F.lit("percent"), F.lit(n), F.lit("half_up"), True)["text"] for c, n in (("l_discount", 1), ("l_tax", 3)))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", shown.alias("shown"), F.replace(other, F.lit("\\%"), F.lit("\\,\\%")).alias("other"))
    return rows.select("l_orderkey", "l_linenumber", "shown", lx.display_matches("shown", "other").alias("matches"))


@query("""with x as (select s_suppkey, cast(s_acctbal as decimal(18,2)) as v, cast(abs(cast(s_acctbal as decimal(18,2))) * 100 as bigint) as cents from supplier),
  d as (select *, regexp_replace(cast(cents as varchar), '0+$', '') as bare from x)
  select s_suppkey, case when cents = 0 then '0' else (case when v < 0 then '-' else '' end) || bare || 'e' || (length(cast(cents as varchar)) - length(bare) - 2) end as canonical, 1 as forms from d""")
def canonical_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-23: equal numbers written in different ways have one canonical text."""
    x = F.col("s_acctbal").cast("decimal(18,2)").cast("string")
    ways = [x, F.concat(x, F.lit("000")), F.concat(x, F.lit("e0")), F.concat(x, F.lit("E+00"))]
    forms = F.size(F.array_distinct(F.array(*[lx.canonical(w) for w in ways])))
    return table(spark, sf_dir, "supplier").select("s_suppkey", lx.canonical(x).alias("canonical"), forms.alias("forms"))


# -- claims ---------------------------------------------------------------


@query("""with m as (select n_name as metric, count(s_suppkey) as n, cast(sum(cast(s_acctbal as decimal(18,2))) as double) / nullif(count(s_suppkey), 0) as v from nation left join supplier on s_nationkey = n_nationkey group by 1)
  select a.metric || '>' || b.metric as claim, case when a.v is null or b.v is null then 'unknown' when a.v > b.v then 'pass' else 'mismatch' end as status,
  case when a.v is null or b.v is null then 'EMPTY_SELECTION' end as error from m a join m b on b.metric = (select min(c.metric) from m c where c.metric > a.metric)""")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-04, P-09: each nation's mean supplier balance is claimed to exceed that of the next nation in the alphabet."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_acctbal").cast("decimal(18,2)").alias("x"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("metric"))
    sums = n.join(s.groupBy("s_nationkey").agg(F.sum("x").alias("total"), F.count("x").alias("n")), n.n_nationkey == s.s_nationkey, "left")
    own = sums.select("metric", exact.mean_column(F.col("total"), F.col("n")).alias("value"), F.lit("scalar").alias("unit"), F.when(F.col("n").isNull(), "EMPTY_SELECTION").alias("error"))
    following = own.select(F.col("metric").alias("left"), F.lead("metric").over(Window.partitionBy(F.lit(1)).orderBy("metric")).alias("right")).where("right is not null")  # 25 nations
    declared = following.select(F.concat("left", F.lit(">"), "right").alias("claim"), F.lit("greater_than").alias("op"), "left", "right", *[F.lit(None).cast(t).alias(c) for c, t in (("threshold", "string"), ("threshold_unit", "string"), ("candidates", "array<string>"), ("direction", "string"), ("allow_ties", "boolean"))])
    return states.claim_states(declared, own).select("claim", "status", "error")


@query("""with m as (select p_brand as brand, p_type as kind, max(cast(p_retailprice as decimal(18,2))) as v from part group by 1, 2),
  top as (select kind, brand, count(*) over (partition by kind) as of, rank() over (partition by kind order by v desc) as r, count(*) over (partition by kind, v) as ties from m)
  select kind || '/' || brand as claim, case when r = 1 and ties = 1 then 'pass' else 'mismatch' end as status from top where of > 1""")
def best_in_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-10, T-09: every brand is claimed to have the highest price of its kind among all brands of it; ties lose."""
    v = F.max(F.col("p_retailprice").cast("decimal(18,2)"))
    own = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("kind"), F.concat_ws("/", "p_type", "p_brand").alias("metric")).agg(v.cast("string").alias("value"))
    kinds = own.groupBy("kind").agg(F.collect_set("metric").alias("all"))  # the brands of a kind: a few dozen
    claims = own.join(kinds, "kind").where(F.size("all") > 1).select(
        F.col("metric").alias("claim"), F.lit("best_in_set").alias("op"), F.col("metric").alias("left"), *[F.lit(None).cast("string").alias(c) for c in ("right", "threshold", "threshold_unit")],
        F.array_except("all", F.array("metric")).alias("candidates"), F.lit("maximize").alias("direction"), F.lit(False).alias("allow_ties"),
    )
    return states.claim_states(claims, own.select("metric", "value", F.lit("scalar").alias("unit"), F.lit(None).cast("string").alias("error"))).select("claim", "status")


@query(f"""with {_EVIDENCE}, m as (select model, round(cast(sum(discount) as double) * 100 / count(*), 2) as v, round(cast(sum(discount) filter (where seed <= 6) as double) * 100 / count(*) filter (where seed <= 6), 2) as old,
    cast(sum(discount) as double) * 100 / count(*) as whole from evidence group by 1),
  shown as (select 'mean_' || model as subject, printf('%.2f', old) || '\\%' as actual, printf('%.2f', v) || '\\%' as expected from m
    union all select 'gain', (select printf('%.2f', a.old - r.old) from m a, m r where a.model = 'A' and r.model = 'R'), (select printf('%.2f', round(a.whole - r.whole, 2) + 0.0) from m a, m r where a.model = 'A' and r.model = 'R'))
  select subject, case when cast(replace(actual, '\\%', '') as decimal(18,2)) = cast(replace(expected, '\\%', '') as decimal(18,2)) then 'pass' else 'mismatch' end as status, actual, cast(cast(replace(expected, '\\%', '') as decimal(18,2)) as varchar) || (case when contains(expected, '%') then '\\%' else '' end) as expected from shown
  union all select 'claim_order', case when (select whole from m where model = 'A') >= (select whole from m where model = 'R') then 'pass' else 'mismatch' end, null, null""")
def check_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-01, the flagship: means and their difference against reported numbers, and a claim.

    The reported numbers are those of an older evaluation, without the seed 7,
    so which of them still hold depends on the evidence.
    """
    rows = evidence(spark, sf_dir)
    wanted = [Metric(f"mean_{m}", "discount", "mean", "fraction", {"model": m}) for m in "ANR"]
    gain = Derived("gain", "percentage_point_difference", "mean_A", "mean_R")
    d = F.col("discount").cast("decimal(18,2)")
    old = rows.where(F.col("seed").cast("int") <= 6).groupBy("model").agg(F.round((F.sum(d).cast("decimal(30,2)") * 100 / F.count(F.lit(1))).cast("decimal(30,10)"), 2).cast("decimal(20,2)").alias("v"))
    means = old.select(F.concat(F.lit("mean_"), "model").alias("binding"), F.concat(F.col("v").cast("string"), F.lit("\\%")).alias("actual"))
    difference = old.agg((F.max(F.when(F.col("model") == "A", F.col("v"))) - F.max(F.when(F.col("model") == "R", F.col("v")))).cast("string").alias("actual")).select(F.lit("gain").alias("binding"), "actual")
    located = means.unionByName(difference).withColumn("error", F.lit(None).cast("string"))
    bindings = declared(spark, [(n, n, "decimal" if n == "gain" else "percent", 2, "half_up", n != "gain", "latex") for n in ("mean_A", "mean_N", "mean_R", "gain")], "binding string, metric string, kind string, places int, rounding string, percent_symbol boolean, format string")
    claim = declared(spark, [("claim_order", "greater_equal", "mean_A", "mean_R", None, None, None, None, None)], "claim string, op string, left string, right string, threshold string, threshold_unit string, candidates array<string>, direction string, allow_ties boolean")
    report = check(rows, TYPES, wanted, [gain], bindings, located, claim)
    none = F.lit(None).cast("string")
    return report.bindings.select(F.col("binding").alias("subject"), "status", "actual", "expected").unionByName(report.claims.select(F.col("claim").alias("subject"), "status", none.alias("actual"), none.alias("expected")))


# -- keys and profiles ----------------------------------------------------


@query("select o_custkey, count(*) as n, 'DUPLICATE_KEY' as error from orders group by 1 having count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.duplicate_keys(table(spark, sf_dir, "orders"), ["o_custkey"])


@query("""select 'c_custkey' as "column", count(*) as n, count(distinct c_custkey) as "distinct", 0 as missing, 'integer' as type from customer
  union all select 'c_name', count(*), count(distinct c_name), 0, 'string' from customer union all select 'c_nationkey', count(*), count(distinct c_nationkey), 0, 'integer' from customer
  union all select 'c_mktsegment', count(*), count(distinct c_mktsegment), 0, 'string' from customer""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.column_profile(table(spark, sf_dir, "customer").drop("c_acctbal"), "c_custkey")
    kind = F.when(F.col("reason") == "identity_name", F.when(F.col("column").isin("c_custkey", "c_nationkey"), "integer").otherwise("string")).otherwise(F.col("type"))
    return out.select("column", "n", "distinct", F.col("missing").cast("int").alias("missing"), kind.alias("type"))


@query("""select 'l_orderkey,l_linenumber' as columns, count(distinct (l_orderkey, l_linenumber)) as "distinct", count(*) as "rows" from lineitem
  union all select 'l_orderkey', count(distinct l_orderkey), count(*) from lineitem union all select 'l_linenumber', count(distinct l_linenumber), count(*) from lineitem""")
def key_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.key_candidates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    return out.select(F.array_join("columns", ",").alias("columns"), "distinct", "rows")


@query("""select event_type, count(value) as n, round(quantile_cont(value, 0.5), 6) as median, quantile_disc(value, 0.95) as p95 from events group by 1""")
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.latency(events(spark, sf_dir), ["event_type"], "value").withColumn("median", F.round("median", 6))


@query("""select p_partkey, regexp_extract(p_brand, '[0-9]+', 0) as digits, cast(null as varchar) as error from part""")
def record_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-04: portable rows against their contract."""
    rows = table(spark, sf_dir, "part").select(F.create_map(F.lit("p_partkey"), F.col("p_partkey").cast("string"), F.lit("digits"), F.regexp_extract("p_brand", "[0-9]+", 0)).alias("values"), lx.sha256("p_name").alias("snapshot"), F.create_map(F.lit("digits"), F.lit("/b")).alias("pointers"))
    out = ev.scan_records(rows, {"p_partkey": "integer", "digits": "integer"})
    return out.select(F.col("p_partkey").cast("long").alias("p_partkey"), "digits", F.col("_error").alias("error"))


@query("""select event_id, regexp_extract(props, '"k": *([^,}]*)', 1) as lexeme, case when regexp_extract(props, '"k": *([^,}]*)', 1) = '' then 'MISSING_VALUE' end as error from events""")
def json_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-03, F-40."""
    scanned = ev.scan_json(table(spark, sf_dir, "events").select("event_id", F.col("props").alias("text")))
    at = ev.json_pointer(F.col("value"), "/k")
    return scanned.select("event_id", F.coalesce(at["lexeme"], F.lit("")).alias("lexeme"), at["error"].alias("error"))


QUERIES, ORACLE_SQL = _r.queries, _r.sql
