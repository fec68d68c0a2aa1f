"""Queries on sources and sinks: the driver's tables are written as files in the shared folder and scanned again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions import lexeme as lx
from concordat.operators import metrics as mx
from concordat.operators import profile, scoring
from concordat.operators.scratch import Scratch
from concordat.plans import review
from concordat.plans.register import Register
from concordat.plans.vehicles import lineage, table
from concordat.sources import documents as docs_
from concordat.sources import evidence as ev
from concordat.sources import exports, sinks

_r = Register()
query = _r.query


# -- delimited files --------------------------------------------------------


def _delimited(spark: SparkSession, sf_dir: str, separator: str) -> DataFrame:
    """part as a delimited file, unquoted: some rows have a bad size, some a separator in the name, some no size."""
    k = F.col("p_partkey")
    name = F.when(k % 50 == 9, F.lit(f"a{separator}b")).otherwise(F.regexp_replace("p_name", "[,\t\"]", " "))
    size = F.when(k % 50 == 7, F.concat(F.lit("x"), "p_size")).when(k % 50 != 8, F.col("p_size").cast("string"))
    path = f"{Scratch(spark, 'files').root}/part"
    table(spark, sf_dir, "part").select(k.cast("string").alias("p_partkey"), name.alias("p_name"), size.alias("p_size")).write.csv(path, sep=separator, header=True, quote="", emptyValue="", nullValue="")
    assert ev.header_error(spark, path, ["p_partkey", "p_size"], separator) is None
    rows = ev.scan_delimited(spark, path, ev.header(spark, path, separator), separator)
    typed = ev.typed(rows, {"p_partkey": "integer", "p_name": "string", "p_size": "integer"}, blank_is_missing=separator == "\t")
    return typed.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.when(F.col("_error").isNull(), F.col("p_size").cast("int")).alias("p_size"), F.col("_error").alias("error"))


_DELIMITED = """select p_partkey, case when p_partkey % 50 not in (7, 8, 9) then p_size end as p_size, case when p_partkey % 50 = 9 then 'MALFORMED_ROW' when p_partkey % 50 = 7 then 'COLUMN_TYPE' {} end as error from part"""


@query(_DELIMITED.format("when p_partkey % 50 = 8 then 'COLUMN_TYPE'"))
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-01, P-04, P-05: long rows and bad cells are errors, an empty number too."""
    return _delimited(spark, sf_dir, ",")


@query(_DELIMITED.format(""))
def tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-02: as with commas, but an empty number is a missing one."""
    return _delimited(spark, sf_dir, "\t")


# -- JSON -------------------------------------------------------------------


@query("""select o_orderkey as doc_id, '/a~1b' as pointer, o_orderstatus as lexeme from orders union all select o_orderkey, '/n~0/k/0', o_orderpriority from orders union all select o_orderkey, '/n~0/k/1', cast(o_custkey as varchar) from orders""")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-11, F-41, F-44, F-46: all leaves of nested objects and arrays, with escaped pointers."""
    inner = F.struct(F.array("o_orderpriority", F.col("o_custkey").cast("string")).alias("k"))
    text = F.to_json(F.struct(F.col("o_orderstatus").alias("a/b"), inner.alias("n~")))
    made = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    return ev.json_leaves(made, depth=3).select("doc_id", "pointer", "lexeme")


@query("""select s_suppkey, '{"balance":' || regexp_replace(regexp_replace(cast(cast(s_acctbal as decimal(18,2)) as varchar), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || ',"name":"' || s_name || '","nation":' || case when s_nationkey = 3 then 'null' else cast(s_nationkey as varchar) end || '}' as json from supplier""")
def exact_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-25: sorted keys, decimals in full and unquoted."""
    fields = {"name": (F.col("s_name"), "string"), "balance": (F.concat(F.col("s_acctbal").cast("decimal(18,2)").cast("string"), F.lit("00")), "decimal"), "nation": (F.when(F.col("s_nationkey") != 3, F.col("s_nationkey")), "integer")}
    return table(spark, sf_dir, "supplier").select("s_suppkey", lx.exact_json(fields).alias("json"))


# -- files and documents ----------------------------------------------------


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The suppliers of each nation as one text file, in order."""
    path = f"{Scratch(spark, 'files').root}/texts"
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", "s_name").repartition("k").sortWithinPartitions("k", "s_suppkey")
    rows.select("k", F.col("s_name").alias("value")).write.partitionBy("k").text(path)
    return path


_FILES = "f as (select s_nationkey as k, string_agg(s_name, chr(10) order by s_suppkey) || chr(10) as text from supplier group by 1)"


@query(f"""with {_FILES} select k, cast(strlen(text) as bigint) as bytes, 'sha256:' || sha256(text) as sha256 from f""")
def file_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-08, S-15, S-16: all files below a folder with their content's hash."""
    found = ev.content_identities(spark, _written(spark, sf_dir), [".txt"])
    return found.select(F.regexp_extract("path", "/k=([0-9]+)/", 1).cast("int").alias("k"), "bytes", "sha256")


@query(f"""with {_FILES} select k, 'text' as format, len(text) as n_chars, 'sha256:' || sha256(text) as sha256, false as repeated from f""")
def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-12: documents below a folder, decoded, none read twice."""
    found = docs_.corpus(spark, _written(spark, sf_dir), [".txt", ".md"])
    met = found.join(docs_.repeated(found).select("file", F.lit(True).alias("again")), "file", "left")
    return met.select(F.regexp_extract("file", "/k=([0-9]+)/", 1).cast("int").alias("k"), "format", F.length("text").cast("long").alias("n_chars"), "sha256", F.coalesce("again", F.lit(False)).alias("repeated"))


@query("""select c_custkey as k, case when c_custkey % 6 = 0 then 'left' else 'right' end as side from customer where c_custkey % 3 = 0""")
def snapshot_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-18, S-09, E-07, E-08: a report written once and read back, and its differences to a later one."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    root = Scratch(spark, "snapshots").root
    sinks.write_snapshot(c.where("k % 3 <> 0 or k % 2 = 0"), root, "first")
    return exports.same_rows(sinks.read_snapshot(spark, root, "first"), c.where("k % 6 <> 0")).select("k", "side")


@query("""select c_custkey as k from customer where c_custkey % 10 = 3""")
def snapshot_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-08: stored contents that no longer have the hash under which they were stored."""
    c = exports.snapshot(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("content")))
    edited = c.withColumn("content", F.when(F.col("k") % 10 == 3, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return ev.verify_snapshots(edited).select("k")


@query("""select 'customer' as source, count(*) as record_count, 'k,name' as columns, (select string_agg(cast(c_custkey as varchar), ',' order by c_custkey) from (select c_custkey from customer order by c_custkey limit 7 offset 14)) as page from customer""")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-10, T-02: how many rows and which columns a source has, and its third page of seven."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    total, page = ev.summary(rows, ["k"], 14, 7)
    shown = page.agg(F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda x: x.cast("string")), ",").alias("page"))  # seven rows
    return total.crossJoin(shown).select(F.lit("customer").alias("source"), "record_count", F.array_join("columns", ",").alias("columns"), "page")


@query("""select o_orderkey as k, case o_orderstatus when 'F' then 'VALUE_MISMATCH' else 'ANCHOR_MISSING' end as rule, case o_orderstatus when 'F' then 'error' when 'O' then 'warning' else 'note' end as level,
  case when o_orderkey % 2 = 0 then 'doc' || o_custkey end as uri, case when o_orderkey % 2 = 0 then o_orderkey % 90 + 1 end as line from orders""")
def sarif_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-19: findings as objects of the exchange format, written and read back."""
    k = F.col("o_orderkey")
    placed = k % 2 == 0
    found = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "VALUE_MISMATCH").otherwise("ANCHOR_MISSING").alias("rule"), k.cast("string").alias("subject"),
        F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "O", "unknown").otherwise("info").alias("severity"),
        F.when(placed, F.concat(F.lit("doc"), "o_custkey")).alias("file"), F.when(placed, k % 90 + 1).alias("line"), k.cast("string").alias("message"),
    )
    path = f"{Scratch(spark, 'sarif').root}/findings"
    sinks.write_sarif(found, path)
    read = spark.read.schema("ruleId string, level string, message struct<text string>, locations array<struct<physicalLocation struct<artifactLocation struct<uri string>, region struct<startLine long>>>>").json(path)
    at = F.get("locations", F.lit(0))["physicalLocation"]
    return read.select(F.col("message.text").cast("long").alias("k"), F.col("ruleId").alias("rule"), "level", at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("line"))


# -- run histories ----------------------------------------------------------


@query("""with r as (select o_orderkey as run_id, o_orderstatus as s from orders where o_orderkey % 5 <> 0), h as (select l_orderkey as run_id, l_linenumber as "row", row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as i, l_linenumber % 2 = 1 as has, cast(cast(l_quantity as decimal(18,2)) as varchar) as q from lineitem)
  select r.run_id, 'loss' as metric, h.i as record_index, case when has then q end as value, case when has then 'observed' else 'missing' end as status, cast("row" as bigint) as step from r join h using (run_id)
  union all select run_id, 'loss', 0, null, 'not_logged', null from r where run_id not in (select run_id from h)""")
def sparse_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-06: unsampled histories in which a metric is absent from some rows; runs that are still active are left out."""
    from pyspark.sql import Window

    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 5 == 0, "running").otherwise("finished").alias("status"), F.create_map(F.lit("x"), F.lit("y")).alias("config"))
    n = F.col("l_linenumber")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    loss = F.when(n % 2 == 1, F.create_map(F.lit("loss"), F.col("l_quantity").cast("decimal(18,2)").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    history = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), place.alias("row"), F.map_concat(loss, F.create_map(F.lit("_step"), n.cast("string"))).alias("values"))
    out = exports.project_wandb(runs, history, ["loss"], ["x"])
    return out.select("run_id", "metric", "record_index", "value", "status", "step")


# -- contracts --------------------------------------------------------------


@query("""with a as (select l_orderkey as k, count(*) as n from lineitem group by 1), b as (select o_orderkey as k, count(*) as n from orders where o_orderkey % 9 <> 0 group by 1)
  select coalesce(a.k, b.k) as k, coalesce(a.n, 0) as records, coalesce(b.n, 0) as locations, case when b.n is null then 'LOCATION_MISSING' when a.n is null then 'RECORD_MISSING' when a.n > 1 or b.n > 1 then 'RECORD_COUNT' end as error from a full join b on a.k = b.k""")
def reconciled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-28: records (lines) against locations (orders), one to one."""
    records = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    return mx.reconciled(records, table(spark, sf_dir, "orders").where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("k")), ["k"])


@query("""select s_suppkey as target, case when s_suppkey % 5 = 0 then 0 when s_suppkey % 5 = 1 then 2 else 1 end as boxes, case when s_suppkey % 5 = 0 then 'missed' when s_suppkey % 5 = 1 then 'ambiguous' else 'supported' end as outcome from supplier""")
def container_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-04, J-24: gold tokens in extracted containers: in one, in two that overlap, or in one that holds another text."""
    s = table(spark, sf_dir, "supplier")
    k, y = F.col("s_suppkey"), (F.col("s_suppkey") * 10).cast("double")
    gold = s.select(k.alias("token_id"), F.floor(k / 100).alias("page"), F.lit(10.0).alias("x0"), y.alias("y0"), F.lit(20.0).alias("x1"), (y + 5).alias("y1"), k.cast("string").alias("text"))
    box = s.select(F.floor(k / 100).alias("page"), F.lit(0.0).alias("bx0"), (y - 1).alias("by0"), F.lit(50.0).alias("bx1"), (y + 6).alias("by1"), F.when(k % 5 == 0, F.concat(F.lit("no 9"), k)).otherwise(F.concat(F.lit("Supplier "), k, F.lit(" here"))).alias("box_text"), k)
    boxes = box.select(k.alias("box_id"), *box.columns[:-1]).unionByName(box.where(k % 5 == 1).select((-k).alias("box_id"), *box.columns[:-1]))
    return scoring.containers(gold, boxes).select("target", F.col("boxes").cast("int").alias("boxes"), "outcome")


@query("""with n as (select c_nationkey as k, count(*) as n from customer group by 1)
  select 'metric' as stage, 'm' || n_nationkey as name, case when n_nationkey % 7 = 0 then 'NAME_CONFLICT' when n_nationkey % 5 = 1 then 'MISSING_COLUMN' when n_nationkey % 5 = 2 then 'COLUMN_TYPE' when n is null then 'EMPTY_SELECTION' when n_nationkey % 2 = 1 then 'RECORD_COUNT' end as error from nation left join n on k = n_nationkey
  union all select * from (values ('source', 'customer.balance', null), ('source', 'customer.key', null), ('source', 'customer.name', null), ('source', 'customer.absent', 'MISSING_COLUMN'), ('source', 'customer.segment', 'COLUMN_TYPE')) v(stage, name, error)""")
def staged_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-23: columns and metrics about to be declared, held against what the source has now."""
    customer = table(spark, sf_dir, "customer")
    rows = customer.select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"), F.concat(F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("1")).alias("balance"), F.col("c_mktsegment").alias("segment"))
    found = profile.column_profile(rows).select(F.lit("customer").alias("source"), "column", F.when(F.col("column").isin("key"), "integer").when(F.col("column") == "balance", "decimal").otherwise("string").alias("type"))
    declared = spark.createDataFrame([("customer", c, t) for c, t in (("key", "integer"), ("name", "string"), ("balance", "decimal"), ("segment", "decimal"), ("absent", "decimal"))], "source string, column string, type string")
    seen = customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("seen"))
    n = table(spark, sf_dir, "nation").join(seen, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    k = F.col("n_nationkey")
    wanted = n.select(F.concat(F.lit("m"), k).alias("name"), F.lit("customer").alias("source"), F.when(k % 5 == 1, "nowhere").when(k % 5 == 2, "name").otherwise("balance").alias("field"), F.when(k % 2 == 1, F.col("seen") + 1).otherwise(F.col("seen")).alias("expected_count"), "seen")
    return review.staged(found, declared, wanted, n.where(k % 7 == 0).select(F.concat(F.lit("m"), k).alias("name")))


@query("""select 'c' || c_custkey as name, case when n_regionkey = 1 then 'lost' when n_regionkey = 2 or n_nationkey % 6 = 0 then 'check_again' else 'kept' end as state,
  concat_ws(',', case when n_nationkey % 6 = 0 then 'n' || n_nationkey end, case when n_regionkey in (1, 2) then 'r' || n_regionkey end) as changed from customer join nation on n_nationkey = c_nationkey""")
def rebuilt_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-26: chosen customers after a region went, another one and some nations changed."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    before = n.select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.col("n_name").alias("fingerprint")).unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias("name"), F.col("r_name").alias("fingerprint")))
    changed = (F.col("name") == "r2") | (F.col("name").startswith("n") & (F.substring("name", 2, 9).cast("int") % 6 == 0))
    after = before.where("name <> 'r1'").withColumn("fingerprint", F.when(changed, "new").otherwise(F.col("fingerprint")))
    chosen = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"))
    return review.rebuilt_draft(chosen, lineage(spark, sf_dir), before, after).select("name", "state", F.array_join("changed", ",").alias("changed"))


@query("""select o_orderkey as k, case when o_orderkey % 3 = 0 then 'doc' || o_custkey || ', table 2, row ' || (o_orderkey % 7) || ', column 1' when o_orderkey % 3 = 1 then 'doc' || o_custkey || ':' || (o_orderkey % 90) else 'doc' || o_custkey end as label from orders""")
def location_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-36."""
    k = F.col("o_orderkey")
    label = lx.location_label(F.concat(F.lit("doc"), "o_custkey"), F.when(k % 3 == 1, "latex").otherwise("pdf"), (k % 90).cast("string"), F.when(k % 3 == 0, "2"), (k % 7).cast("string"), F.lit("1"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), label.alias("label"))


QUERIES, ORACLE_SQL = _r.queries, _r.sql
