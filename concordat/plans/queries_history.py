"""Queries on change over time: baselines, transitions, impacts, provenance, exports, scores and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordat.functions import lexeme as lx
from concordat.operators import graphs, provenance, scoring, states
from concordat.operators.scratch import Scratch
from concordat.plans.register import Register
from concordat.plans.vehicles import documents, events, lineage, table
from concordat.sources import exports, sinks
from concordat.sources import documents as docs_
from concordat.streaming import feed

_r = Register()
query = _r.query

_SIDES = """before as (select o_custkey, count(*) as n, sum(cast(o_totalprice as decimal(18,2))) as v from orders where o_orderdate < timestamp '1995-01-01' group by 1),
  after as (select o_custkey, count(*) as n, sum(cast(o_totalprice as decimal(18,2))) as v from orders where o_orderstatus <> 'P' or o_orderdate >= timestamp '1995-01-01' group by 1)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each customer's number and sum of orders, before a date and for another selection of orders."""
    o = table(spark, sf_dir, "orders").withColumn("x", F.col("o_totalprice").cast("decimal(18,2)"))
    old = o.where(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp"))
    new = o.where((F.col("o_orderstatus") != "P") | (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")))
    return tuple(s.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("v")) for s in (old, new))


def _as_metrics(side: DataFrame) -> DataFrame:
    return side.select(F.col("o_custkey").alias("metric"), F.col("v").cast("string").alias("value"), F.when(F.col("n") == 1, "RECORD_COUNT").alias("error"), (F.col("n") > 5).cast("string").alias("definition"), lx.fingerprint("v").alias("fingerprint"))


@query(f"""with {_SIDES} select a.o_custkey as metric, case when b.o_custkey is null then 'added' when a.n = 1 or b.n = 1 then 'unavailable' when (a.n > 5) <> (b.n > 5) then 'definition_changed' when a.v <> b.v then 'changed' else 'unchanged' end as change
  from after a left join before b using (o_custkey)""")
def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-13, C-02."""
    old, new = _sides(spark, sf_dir)
    return states.baseline_changes(_as_metrics(new), _as_metrics(old)).select("metric", "change")


@query("select o_orderkey, o_custkey from orders where o_orderpriority <> '1-URGENT' except select o_orderkey, o_custkey from orders where o_orderstatus = 'O'")
def removed_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-03: orders that aren't urgent and no open ones."""
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderpriority <> '1-URGENT'")
    return states.removed(o.where("o_orderstatus = 'O'"), old, ["o_orderkey", "o_custkey"])




def _status(side: str) -> str:
    return f"case when {side}.n = 1 then 'unknown' when {side}.n % 2 = 0 then 'pass' else 'mismatch' end"


def _as_states(side: DataFrame) -> DataFrame:
    return side.select(F.col("o_custkey").alias("subject"), F.when(F.col("n") == 1, "unknown").when(F.col("n") % 2 == 0, "pass").otherwise("mismatch").alias("status"))


_MOVED = f"""{_SIDES}, m as (select coalesce(a.o_custkey, b.o_custkey) as subject, {_status('b')} as before_, {_status('a')} as after_, a.n as an, b.n as bn from after a full join before b using (o_custkey)),
  s as (select subject, case when bn is not null then before_ end as b, case when an is not null then after_ end as a, bn is not null and subject % 10 = 0 as modified from m),
  t as (select subject, b as before, a as after, case when a is null then 'removed_bindings' when a = 'unknown' then 'unverified' when a = 'mismatch' then case when b = 'mismatch' then 'unchanged_failures' else 'added_failures' end
    when b = 'mismatch' and not modified then 'resolved_failures' end as bucket from s
    union all select subject, b, a, 'changed_contracts' from s where a is not null and a <> 'unknown' and modified)"""


@query(f"with {_MOVED} select subject, before, after, bucket from t where bucket is not null")
def check_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-14: a check whose contract changed (each tenth customer) is never resolved."""
    old, new = map(_as_states, _sides(spark, sf_dir))
    return states.transitions(new, old, old.where(F.col("subject") % 10 == 0).select("subject"))


@query(f"with {_MOVED} select b.bucket, count(t.subject) as n from (select unnest(['added_failures','resolved_failures','unverified','removed_bindings','unchanged_failures','changed_contracts','current_failures_without_baseline']) as bucket) b left join t using (bucket) group by 1")
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-21, C-03."""
    return states.bucket_counts(check_transitions(spark, sf_dir))


@query(f"with {_SIDES} select o_custkey, case when b.n is null then 'added' when a.n is null then 'removed' else 'changed' end as change from after a full join before b using (o_custkey) where a.v is distinct from b.v")
def declaration_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-01, U-04."""
    old, new = (s.withColumn("fingerprint", lx.fingerprint("v")) for s in _sides(spark, sf_dir))
    return states.declaration_diff(old, new, ["o_custkey"]).select("o_custkey", "change")


_GRAPH = """edges as (select 'n' || n_nationkey as src, 'r' || n_regionkey as dst from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer)"""


@query(f"with recursive {_GRAPH}, t as (select src as root, src as node, 0 as depth from edges union select dst, dst, 0 from edges union select t.root, e.dst, t.depth + 1 from t join edges e on t.node = e.src) select root, node, min(depth) as depth from t group by 1, 2")
def dependents_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-18."""
    return graphs.closure(lineage(spark, sf_dir))


@query("""with c as (select 'r' || n_regionkey as root, count(distinct 'n' || n_nationkey) + count(distinct c_custkey) + 1 as metrics, count(distinct o_orderkey) as bindings from nation join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by 1)
  select root, metrics + (select count(*) from nation n where 'r' || n.n_regionkey = root) - (select count(distinct n_nationkey) from nation n join customer on c_nationkey = n_nationkey where 'r' || n.n_regionkey = root) as metrics, bindings from c where bindings > 0""")
def impact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-17, C-05: regions as root metrics, nations and customers as what depends on them, orders as bindings of customers."""
    edges = lineage(spark, sf_dir)
    names = edges.select(F.col("src").alias("metric")).union(edges.select("dst")).distinct()
    bindings = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("binding"), F.concat(F.lit("c"), "o_custkey").alias("metric"))
    none = spark.createDataFrame([], "claim string, refs array<string>")
    out = states.impact_members(edges, names, bindings, none, spark.createDataFrame([], "metric string, path string"), spark.createDataFrame([], "figure string, path string"))
    return out.groupBy("root").agg(F.count_if(F.col("kind") == "metric").alias("metrics"), F.count_if(F.col("kind") == "binding").alias("bindings"))


@query("""with bad as (select distinct o_custkey from orders where o_orderpriority = '1-URGENT'), open as (select o_orderkey, o_custkey from orders where o_orderstatus = 'F')
  select o_orderkey as binding, 'claim:' || o_custkey as blocked_by from open join bad using (o_custkey)""")
def blocked_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-16: finished orders as mismatches, blocked by a failed claim of the same customer."""
    o = table(spark, sf_dir, "orders")
    bindings = o.select(F.col("o_orderkey").alias("binding"), F.concat(F.lit("c"), "o_custkey").alias("metric"), F.when(F.col("o_orderstatus") == "F", "mismatch").otherwise("pass").alias("status"))
    claims = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("claim"), F.lit("mismatch").alias("status"), F.array(F.concat(F.lit("c"), "o_custkey")).alias("refs")).distinct()
    edges = lineage(spark, sf_dir).where("src like 'n%'")
    return states.blocked_by(bindings, claims, edges).select("binding", F.explode("blocked_by").alias("blocked_by"))


@query("""select count(*) as confirmed, count(*) filter (where o_orderstatus = 'O') as pass, count(*) filter (where o_orderstatus = 'F') as mismatch, count(*) filter (where o_orderstatus = 'P') as unknown,
  case when count(*) filter (where o_orderstatus = 'P') > 0 then 2 when count(*) filter (where o_orderstatus = 'F') > 0 then 1 else 0 end as exit_code from orders""")
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-16, A-17."""
    s = _order_states(spark, sf_dir)
    severity = s.where("status <> 'pass'").select(F.when(F.col("status") == "unknown", "unknown").otherwise("error").alias("severity"))
    return states.coverage(s).crossJoin(states.exit_code(severity))  # two single rows


def _order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("subject"), F.col("o_orderpriority").alias("kind"), F.when(s == "O", "pass").when(s == "F", "mismatch").otherwise("unknown").alias("status"))


@query("""select row_number() over (order by case o_orderstatus when 'P' then 0 when 'F' then 1 else 2 end, o_orderpriority, cast(o_orderkey as varchar)) as rank, cast(o_orderkey as varchar) as subject, o_orderpriority as kind from orders""")
def revision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-17, T-04."""
    return states.revision_list(_order_states(spark, sf_dir)).select(F.col("rank").cast("long").alias("rank"), "subject", "kind")


@query("""with f as (select case event_type when 'click' then 'VALUE_MISMATCH' when 'view' then 'ANCHOR_MISSING' when 'purchase' then 'CLAIM_FALSE' else 'SEED_SET' end as rule, case event_type when 'purchase' then 'claim:' else 'occurrence:' end || user_id as subject from events)
  select case rule when 'VALUE_MISMATCH' then 'update_numbers' when 'ANCHOR_MISSING' then 'repair_bindings' when 'CLAIM_FALSE' then 'review_claims' else 'resolve_evidence' end as kind, count(distinct subject) as subjects, count(distinct subject || '/' || rule) as findings from f group by 1
  union all select 'complete_coverage', 1, 0 where (select count(*) from events where value > 50) > 0""")
def action_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-18."""
    t = F.col("event_type")
    rule = F.when(t == "click", "VALUE_MISMATCH").when(t == "view", "ANCHOR_MISSING").when(t == "purchase", "CLAIM_FALSE").otherwise("SEED_SET")
    subject = F.concat(F.when(t == "purchase", "claim:").otherwise("occurrence:"), F.col("user_id"))
    found = events(spark, sf_dir).select(rule.alias("rule"), subject.alias("subject"), F.concat(subject, F.lit("/"), rule).alias("id"), F.lit("error").alias("severity"))
    loose = events(spark, sf_dir).agg(F.count_if(F.col("value") > 50).alias("unbound"), F.lit(0).alias("unregistered"))
    return states.action_counts(states.actions(found, coverage=loose)).select("kind", "subjects", "findings")


# -- provenance -----------------------------------------------------------


@query("""select 'd' || l.doc_id as path, case when d.doc_id is null then 'unavailable:FILE_UNAVAILABLE' else 'sha256:' || sha256(d.text) end as identity from (select distinct doc_id from labels union select 1000000000) l left join documents d using (doc_id)""")
def identity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-15: the documents that labels name, and one that isn't there."""
    wanted = table(spark, sf_dir, "labels").select("doc_id").union(spark.range(1).select(F.lit(1000000000).cast("long"))).select(F.concat(F.lit("d"), "doc_id").alias("path"))
    files = documents(spark, sf_dir).select(F.concat(F.lit("d"), "doc_id").alias("path"), lx.sha256("text").alias("sha256"))
    return provenance.identities(wanted, files)


@query("""select lang || ':' || source as record, case when count(*) filter (where doc_id % 50 = 7) > 0 then 'unknown' when count(*) filter (where doc_id % 20 = 3) > 0 then 'mismatch' else 'pass' end as status,
  count(*) filter (where doc_id % 20 = 3 and doc_id % 50 <> 7) as changed, count(*) filter (where doc_id % 50 = 7) as missing from documents group by 1""")
def producer_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-11, J-12, J-19: records of all documents of a source, some since changed and some gone."""
    d = table(spark, sf_dir, "documents")
    path, now = F.concat(F.lit("d"), "doc_id"), lx.sha256("text")
    records = d.select(F.concat_ws(":", "lang", "source").alias("record"), path.alias("path"), F.when(F.col("doc_id") % 20 == 3, "old").otherwise(now).alias("recorded"))
    current = d.where(F.col("doc_id") % 50 != 7).select(path.alias("path"), now.alias("identity"))
    out = provenance.record_states(records, current)
    return out


@query("""with s as (select c_mktsegment as metric, n_name as file, bool_and(c_acctbal > -900) as ok, bool_or(c_acctbal > 9900) as open from customer join nation on c_nationkey = n_nationkey group by 1, 2),
  x as (select a.n_name as file, b.n_name as source from nation a join nation b on b.n_nationkey = a.n_nationkey + 1),
  l as (select x.file, x.source, s.* exclude (file) from x join s on s.file = x.source), r as (select x.file, x.source, s.* exclude (file) from x join s on s.file = x.file)
  select file, source, metric, case when l.ok is null or r.ok is null or l.open or r.open then 'unknown' when l.ok and r.ok then 'aligned' when l.ok then 'stale' else 'source_outdated' end as status from l full join r using (file, source, metric)""")
def export_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-10, C-13: each nation as the export of the next one, segments as metrics, customers as bindings."""
    n = table(spark, sf_dir, "nation")
    status = F.when(F.col("c_acctbal") > 9900, "unknown").when(F.col("c_acctbal") > -900, "pass").otherwise("mismatch")
    s = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("file"), F.col("c_mktsegment").alias("metric"), status.alias("status"))
    after = n.select((F.col("n_nationkey") - 1).alias("k"), F.col("n_name").alias("source"))
    return provenance.export_states(s, n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("file")).join(after, "k").select("file", "source"))


_HISTORY = """e as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as i from events),
  h as (select u.user_id as run_id, t.event_type as metric, coalesce(i, 0) as record_index, case when e.event_id is null then 'not_logged' when value is null then 'missing' else 'observed' end as status, e.event_id
    from (select distinct user_id from events) u cross join (select distinct event_type from events) t left join e on e.user_id = u.user_id and e.event_type = t.event_type)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories of users as runs and event types as metrics, in pages of 20 entries."""
    e = events(spark, sf_dir)
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    entry = F.struct(F.col("i").alias("o"), F.struct(F.col("value").cast("string").alias("value"), F.col("event_id").cast("string").alias("step"), F.unix_millis("at").cast("string").alias("timestamp"), *[F.lit(None).cast("string").alias(c) for c in ("model_id", "dataset_name", "dataset_digest")]).alias("x"))
    numbered = e.withColumn("i", F.row_number().over(order) - 1)
    return numbered.groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("metric"), F.floor(F.col("i") / 20).cast("int").alias("page")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["x"]).alias("entries"))


@query(f"with {_HISTORY} select * from h")
def history_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-05, S-07, W-04: a metric that a run never logged keeps its row."""
    e = events(spark, sf_dir)
    runs = e.select(F.col("user_id").alias("run_id")).distinct().withColumns({"status": F.lit("FINISHED"), "params": F.create_map(F.lit("a"), F.lit("b"))})
    out = exports.project_mlflow(runs, _pages(spark, sf_dir), e.select(F.col("event_type").alias("metric")), ["a"])
    return out.select("run_id", "metric", "record_index", "status", F.col("step").alias("event_id"))


@query("""with p as (select doc_id as page, case when doc_id % 7 = 3 then 'SNAPSHOT_MISSING' when doc_id % 5 = 2 then 'IMPORT_CHANGED' end as error from documents where text is not null),
  s as (select count(distinct text) as stored from documents where doc_id % 7 <> 3 or exists (select 1 from documents o where o.text = documents.text and o.doc_id % 7 <> 3))
  select page, case when error = 'SNAPSHOT_MISSING' and exists (select 1 from documents a join documents b on a.text = b.text where a.doc_id = page and b.doc_id % 7 <> 3) then case when page % 5 = 2 then 'IMPORT_CHANGED' end else error end as error from p
  where case when error = 'SNAPSHOT_MISSING' and exists (select 1 from documents a join documents b on a.text = b.text where a.doc_id = page and b.doc_id % 7 <> 3) then case when page % 5 = 2 then 'IMPORT_CHANGED' end else error end is not null
  union all select -1, cast(stored as varchar) from s""")
def import_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-08, S-09, C-21: documents as raw pages, stored twice, some left out and some imported otherwise than they project now; the row -1 has how many contents are stored."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("page"), F.col("text").alias("content"))
    root = f"{Scratch(spark, 'imports').root}/store"
    part = d.where("page % 7 <> 3")
    exports.store_pages(part, root)
    store = exports.store_pages(part.where("page % 2 = 0"), root)

    def project(pages: DataFrame) -> DataFrame:
        return pages.select("page", F.length("content").alias("n"), F.regexp_count("content", F.lit(" ")).alias("spaces"))

    imported = project(d).withColumn("n", F.when(F.col("page") % 5 == 2, F.col("n") + 1).otherwise(F.col("n")))
    found = exports.verified_import(imported, d.select("page", lx.sha256("content").alias("sha256")), store, project)
    return found.unionByName(store.agg(F.lit(-1).cast("long").alias("page"), F.count(F.lit(1)).cast("string").alias("error")))


@query("""with p as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as place, lead(turn) over (partition by conv_id order by turn) is null as last, role from conversations),
  b as (select conv_id, max(cast(place <> turn or (role = 'assistant') <> last as integer)) as bad from p group by 1) select conv_id, 'PAGE_SEQUENCE' as error from b where bad = 1""")
def page_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-05: turns as pages; those of the assistant carry no token, as only a last page may."""
    c = table(spark, sf_dir, "conversations")
    pages = c.select(F.col("conv_id").alias("run_id"), F.lit("turns").alias("metric"), F.col("turn").alias("page"), F.when(F.col("role") != "assistant", F.concat_ws("-", "conv_id", "turn")).alias("token"))
    return exports.continuity(pages).select(F.col("run_id").alias("conv_id"), "error")


@query("""select doc_id, case when quality is null then 'unreviewed' when quality = 1 then 'reviewed' else 'superseded' end as review from documents left join (select doc_id, max(quality) as quality from labels group by 1) using (doc_id)""")
def claim_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-15, C-16."""
    claims = documents(spark, sf_dir).select(F.col("doc_id").alias("claim"), F.lit("1").alias("fingerprint"))
    history = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("claim"), F.col("quality").cast("string").alias("fingerprint"))
    return states.reviews(claims, history).select(F.col("claim").alias("doc_id"), "review")


# -- scores ---------------------------------------------------------------

_SCORE = """g as (select lang as "case", doc_id as location, quality from documents join labels using (doc_id)),
  o as (select d.doc_id, d.lang, case when d.n_chars < 100 then 'invalid' when g.location is null then 'wrong_position' when g.quality = 0 then 'contract_mismatch' else 'match' end as outcome from documents d left join g on g.location = d.doc_id and g."case" = d.lang)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    gold = d.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("lang").alias("case"), F.col("doc_id").alias("location"), F.when(F.col("quality") == 0, "other").otherwise("same").alias("contract"), F.lit(True).alias("answerable"))
    sent = d.select(F.col("doc_id").alias("candidate"), F.col("lang").alias("case"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("location"), F.lit("same").alias("contract"), (F.col("n_chars") >= 100).alias("valid"))
    return scoring.mapping_outcomes(sent, gold), gold


@query(f"with {_SCORE} select doc_id as candidate, outcome from o")
def mapping_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-25, E-01."""
    return _outcomes(spark, sf_dir)[0].select("candidate", "outcome")


@query(f"""with {_SCORE} select (select count(*) from o) as submitted, (select count(*) from o where outcome = 'match') as matched, (select count(*) from g) as wanted,
  round((select count(*) from o where outcome = 'match') / (select count(*) from o), 9) as precision""")
def mapping_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-01, E-02."""
    outcomes, gold = _outcomes(spark, sf_dir)
    return scoring.mapping_score(outcomes, gold).select("submitted", "matched", "wanted", F.round("precision", 9).alias("precision"))


@query(f"with {_SCORE} select lang as \"case\", outcome, count(*) as n from o group by grouping sets ((outcome), (lang, outcome))")
def outcome_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-26."""
    return scoring.confusion(_outcomes(spark, sf_dir)[0], ["case"]).select("case", "outcome", "n")


@query("""select event_type, count(*) as actions, count(*) filter (where value < 10) as invalid_actions, sum(user_id) as tokens from events group by 1""")
def usage_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-27."""
    e = events(spark, sf_dir).select("event_type", F.col("user_id").alias("tokens"), F.col("value").alias("seconds"), (F.col("value") >= 10).alias("valid"))
    return scoring.usage(e, ["event_type"]).select("event_type", "actions", "invalid_actions", "tokens")


@query("select o_custkey as path, 'INPUT_CONFLICT' as sha256 from orders group by 1 having count(distinct o_orderpriority) > 1")
def input_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-08: customers as paths, priorities as hashes."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("sha256"))
    return provenance.conflicting_inputs(o).select("path", F.col("error").alias("sha256"))


@query("""select case when lang = 'en' then 'r1' else 'r2' end as fragment, doc_id as ord, case when lang = 'en' then replace(source, '_', '\\_') || ' & \\ensuremath{' || n_chars || '} \\\\' else '| ' || replace(replace(source, '_', '\\_'), '*', '\\*') || ' | ' || n_chars || ' |' end as line from documents""")
def rendered_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-20, F-37: documents' sizes as fragments' lines."""
    en = F.col("lang") == "en"
    d = table(spark, sf_dir, "documents").select(F.when(en, "r1").otherwise("r2").alias("fragment"), F.col("doc_id").alias("ord"), F.col("source").alias("label"), F.col("n_chars").cast("string").alias("value"), F.when(en, "latex").otherwise("markdown").alias("format"))
    return sinks.fragment_lines(d)


@query("""select 'd' || doc_id as path, strlen(text) as bytes, 'sha256:' || sha256(text) as sha256, length(text) > 4096 as truncated, false as missing from documents union all select 'none', null, null, null, true""")
def bundle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-21, U-10."""
    files = documents(spark, sf_dir).select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    required = files.select("path").union(spark.range(1).select(F.lit("none").alias("path")))
    return sinks.bundle_manifest(files, required).select("path", "bytes", "sha256", "truncated", "missing")


@query("""select conv_id || '/' || turn // 50 as path, case role when 'system' then 'not_code' when 'assistant' then 'saved_outputs' else 'unexecuted' end as status, count(*) as n from conversations group by 1, 2""")
def notebook_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-14: conversations as notebooks of fifty turns, assistant turns as executed cells."""
    c = table(spark, sf_dir, "conversations")
    outputs = F.when(F.col("role") == "assistant", F.array(F.struct(F.lit("stream").alias("output_type"), F.col("text").alias("text"))))
    cell = F.struct(F.col("turn").alias("o"), F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(F.col("role") == "system", "markdown").otherwise("code").alias("cell_type"), F.col("text").alias("source"), outputs.alias("outputs"), F.when(F.col("role") == "assistant", F.col("turn")).alias("execution_count")).alias("x"))
    books = c.groupBy(F.concat_ws("/", "conv_id", F.floor(F.col("turn") / 50)).alias("path")).agg(F.transform(F.array_sort(F.collect_list(cell), lambda a, b: (a["o"] - b["o"]).cast("int")), lambda s: s["x"]).alias("cells"))
    return docs_.notebook_cells(books.select("path", F.to_json(F.struct("cells")).alias("text"))).groupBy("path", "status").agg(F.count(F.lit(1)).alias("n"))


# -- streams --------------------------------------------------------------


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    # A pattern, as a stream takes a folder or a pattern but no single file.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("at", F.col("ts").cast("timestamp"))


def _drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there, into a table of the shared folder."""
    spark = stream.sparkSession
    scratch = Scratch(spark, name)
    run = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{scratch.root}/state").option("path", f"{scratch.root}/rows").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{scratch.root}/rows")


@query("""with e as (select user_id, event_type, ts, lag(event_type) over (partition by user_id order by ts, event_type) as before from events),
  c as (select user_id, event_type, ts from e where before is distinct from event_type)
  select user_id, count(*) as changes, cast(max(ts) as timestamp) as last from c group by 1""")
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-01: users as paths, their event types as contents; a repeated content is no change."""
    arrivals = _feed(spark, sf_dir).select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("sha256"), "at")
    out = _drain(feed.content_changes(arrivals), "changes")
    return out.groupBy(F.col("path").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("changes"), F.max("at").cast("timestamp_ntz").alias("last"))


@query("""with e as (select user_id, ts, coalesce(ts >= lag(ts) over (partition by user_id order by ts) + interval 10 minutes, true) as new from events),
  s as (select user_id, ts, sum(cast(new as integer)) over (partition by user_id order by ts rows unbounded preceding) as burst from e), b as (select user_id, burst, min(ts) as began, max(ts) + interval 10 minutes as ended, count(*) as changes from s group by 1, 2)
  select user_id, began, ended, changes from b where ended <= (select max(ts) from events) - interval 1 minute""")
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-02: bursts of a user's events, ten minutes apart, once the watermark has passed them."""
    arrivals = _feed(spark, sf_dir).select(F.col("user_id").alias("project"), "at")
    out = _drain(feed.debounced(arrivals, "10 minutes"), "bursts")
    return out.select(F.col("project").alias("user_id"), F.col("began").cast("timestamp_ntz").alias("began"), F.col("ended").cast("timestamp_ntz").alias("ended"), "changes")


@query("""select event_type, count(*) as n from events group by 1""")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-07: the feed with every event arriving twice gives each one once."""
    arrivals = _feed(spark, sf_dir).select("event_id", "event_type", "at", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    return _drain(feed.without_repeats(arrivals, ["event_id"]), "once").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""with w as (select date_trunc('day', ts) as window_start, event_type, count(*) as n, sum(cast(value as decimal(24,12))) as total, count(*) - count(value) as nulls from events group by 1, 2)
  select window_start, event_type, n, case when nulls = 0 then round(cast(total as double) / n, 6) end as mean from w where window_start + interval 1 day <= (select max(ts) from events) - interval 1 hour""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-08: daily metrics of the feed, each given out once complete."""
    out = _drain(feed.windowed_metrics(_feed(spark, sf_dir), ["event_type"], "value"), "windows")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("""with m as (select user_id, event_type, event_id, date_trunc('millisecond', ts) as ts from events where ts is not null),
  e as (select cast(user_id as varchar) as project, ts, event_type, event_id, coalesce(ts >= lag(ts) over w + interval 10 minutes, true) as new from m window w as (partition by user_id order by ts, event_type, event_id)),
  s as (select *, sum(cast(new as integer)) over (partition by project order by ts, event_type, event_id rows unbounded preceding) as burst from e),
  b as (select project, burst, min(ts) as began, max(ts) + interval 10 minutes as ended, count(*) as changes from s group by 1, 2)
  select project, burst as generation, 'running' as state, ended as at, changes from b where ended <= (select max(ts) from events) - interval 1 minute
    or exists (select 1 from b c where c.project = b.project and c.burst > b.burst)
  union all select project, burst - 1, 'pending', began, 0 from b""")
def stream_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-03, R-06, W-15: users as projects, each event a new content of its type's file; a check runs ten minutes after the last of a burst.

    The feed is sent twice, and the second time changes nothing.
    """
    arrivals = _feed(spark, sf_dir).select(F.col("user_id").cast("string").alias("project"), F.concat_ws("/", "event_type", "event_id").alias("path"), F.lit("sha256:1").alias("sha256"), "at", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, feed.STATE_STORE)
    try:
        return _drain(feed.verdict_states(arrivals, quiet_ms=600_000), "verdicts").withColumn("at", F.col("at").cast("timestamp_ntz"))
    finally:
        spark.conf.set(name, before)


QUERIES, ORACLE_SQL = _r.queries, _r.sql
