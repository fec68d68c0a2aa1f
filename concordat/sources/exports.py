"""Tracking exports: raw pages of run histories as long, contract-checked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordat.functions.lexeme import measurement, sha256
from concordat.operators.scratch import Scratch

# Run states that may be imported, by tracking system.
TERMINAL = {"mlflow": ["FINISHED", "FAILED", "KILLED"], "wandb": ["finished", "failed", "killed", "crashed"]}


#: Metrics of one import; their list is broadcast.
MOST_METRICS = 10_000


def continuity(pages: DataFrame) -> DataFrame:
    """W-05: (run_id, metric, error) of histories whose pages (run_id, metric, page, token) aren't 0..n-1 with a token on all but the last and none twice."""
    w = Window.partitionBy("run_id", "metric").orderBy("page")
    marked = pages.withColumns({"place": F.row_number().over(w) - 1, "last": F.lead("page").over(w).isNull()})
    bad = (F.col("place") != F.col("page")) | (F.col("token").isNull() != F.col("last"))
    n = marked.groupBy("run_id", "metric").agg(F.max(bad.cast("int")).alias("bad"), F.count("token").alias("tokens"), F.count_distinct("token").alias("different"))
    return n.where("bad = 1 or tokens <> different").select("run_id", "metric", F.lit("PAGE_SEQUENCE").alias("error"))


def terminal(runs: DataFrame, system: str) -> DataFrame:
    """P-12: adds ``error`` (ACTIVE_RUN) to runs that haven't ended."""
    return runs.withColumn("error", F.when(~F.coalesce(F.col("status").isin(*TERMINAL[system]), F.lit(False)), "ACTIVE_RUN"))


def project_mlflow(runs: DataFrame, pages: DataFrame, metrics: DataFrame, identity: list[str]) -> DataFrame:
    """S-05, S-07, F-16, F-39, F-45, W-04: long rows of paged metric histories.

    ``runs`` (run_id, status, params map), ``pages`` (run_id, metric, page,
    entries array of struct(value, step, timestamp, model_id, dataset_name,
    dataset_digest)), ``metrics`` (metric) is what to import.  A metric without
    entries gives one row of status not_logged.
    """
    listed = metrics.select("metric").distinct()
    if listed.limit(MOST_METRICS + 1).count() > MOST_METRICS:
        raise ValueError(f"an import declares at most {MOST_METRICS} metrics")
    wanted = terminal(runs, "mlflow").where("error is null").crossJoin(F.broadcast(listed))
    flat = pages.select("run_id", "metric", "page", F.posexplode("entries").alias("pos", "e"))
    met = wanted.join(flat, ["run_id", "metric"], "left")
    w = Window.partitionBy("run_id", "metric").orderBy("page", "pos")
    value = measurement(F.col("e.value"))
    there = F.col("pos").isNotNull()
    return met.select(
        "run_id",
        "metric",
        (F.row_number().over(w) - 1).cast("long").alias("record_index"),
        F.when(there, value["value"]).alias("value"),
        F.when(~there, "not_logged").otherwise(value["status"]).alias("status"),
        F.when(F.col("e.step").try_cast("double") == F.floor(F.col("e.step").try_cast("double")), F.col("e.step").try_cast("double").cast("long")).alias("step"),
        F.col("e.timestamp").try_cast("long").alias("timestamp"),
        F.when(there, "ms").alias("timestamp_unit"),
        F.timestamp_millis(F.col("e.timestamp").try_cast("long")).alias("at"),
        *[F.try_element_at("params", F.lit(i)).alias(i) for i in identity],
        "e.model_id",
        "e.dataset_name",
        "e.dataset_digest",
    )


def project_wandb(runs: DataFrame, history: DataFrame, metrics: list[str], identity: list[str]) -> DataFrame:
    """S-06, S-07, F-39: long rows of unsampled histories (run_id, row, values map with _step and _timestamp); a metric absent from a row is missing."""
    wanted = terminal(runs, "wandb").where("error is null").select("run_id", "config", F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    met = wanted.join(history, "run_id", "left")
    w = Window.partitionBy("run_id", "metric").orderBy("row")
    # What is sorted for the records' numbers are the few values that are kept, not the maps that hold them, once for each metric.
    inner = [F.try_element_at("config", F.lit(i)).alias(f"_identity_{k}") for k, i in enumerate(identity)]
    stamp = F.try_element_at("values", F.lit("_timestamp")).try_cast("double").alias("_stamp")
    step = F.try_element_at("values", F.lit("_step")).try_cast("long").alias("step")
    narrow = met.select("run_id", "metric", "row", F.try_element_at("values", F.col("metric")).alias("_raw"), step, stamp, *inner)
    numbered = narrow.withColumn("record_index", (F.row_number().over(w) - 1).cast("long"))
    value = measurement(F.col("_raw"))
    there = F.col("row").isNotNull()
    return numbered.select(
        "run_id",
        "metric",
        "record_index",
        F.when(there, value["value"]).alias("value"),
        F.when(~there, "not_logged").otherwise(value["status"]).alias("status"),
        "step",
        F.col("_stamp").cast("long").alias("timestamp"),
        F.when(there, "s").alias("timestamp_unit"),
        F.timestamp_seconds("_stamp").alias("at"),
        *[F.col(f"_identity_{k}").alias(i) for k, i in enumerate(identity)],
    )


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """S-09, E-07, E-08: rows that one side has more often than the other, with the side; empty if the tables are equal."""
    columns = left.columns
    a = left.exceptAll(right.select(*columns)).withColumn("side", F.lit("left"))
    b = right.select(*columns).exceptAll(left).withColumn("side", F.lit("right"))
    return a.unionByName(b)


def snapshot(content: DataFrame) -> DataFrame:
    """S-08: adds the content's sha256, under which it is stored."""
    return content.withColumn("sha256", sha256("content"))


def store_pages(pages: DataFrame, root: str) -> DataFrame:
    """S-08, C-21: writes raw pages (page, content) into the store below ``root`` and returns it: (sha256, content), each content once.

    The store is partitioned by the first two digits of the hash, and only the
    partitions that get something new are written again, whole.  So importing
    the same pages twice, or running a failed import again, adds nothing.
    """
    spark = pages.sparkSession
    fresh = snapshot(pages.select("content").distinct()).select("sha256", "content", F.substring("sha256", F.lit(8), F.lit(2)).alias("prefix"))
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        held = spark.read.schema(fresh.schema).parquet(root)
        fresh = fresh.join(held.select("sha256"), "sha256", "left_anti")
        scratch = Scratch(spark, "store")
        new = scratch.save(fresh, "new")
        # What is read is written elsewhere first: the partitions cannot be read while they are replaced.
        fresh = scratch.save(held.join(new.select("prefix").distinct(), "prefix", "left_semi").select(*fresh.columns).unionByName(new), "whole")
    fresh.repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(root)
    return spark.read.schema(fresh.schema).parquet(root).select("sha256", "content")


def verified_import(imported: DataFrame, manifest: DataFrame, store: DataFrame, project) -> DataFrame:
    """S-09, C-21: (page, error) of an import that doesn't hold against its stored raw pages.

    ``manifest`` (page, sha256) names the pages, ``store`` (sha256, content) is
    what ``store_pages`` keeps, and ``project`` makes the imported rows (page
    and others) of (page, content).  ``SNAPSHOT_MISSING``: a page is not in the
    store; ``SNAPSHOT_HASH``: its content is no longer that of its name;
    ``IMPORT_CHANGED``: projecting it again gives other rows than imported.
    """
    met = manifest.select("page", F.col("sha256").alias("named")).join(store.select(F.col("sha256").alias("named"), "content"), "named", "left")
    there = F.col("content").isNotNull()
    broken = met.select("page", F.when(~there, "SNAPSHOT_MISSING").when(sha256("content") != F.col("named"), "SNAPSHOT_HASH").alias("error")).where("error is not null")
    again = project(met.where(there).select("page", "content"))
    kept = imported.join(met.where(there).select("page"), "page", "left_semi").select(*again.columns)
    differing = same_rows(kept, again).select("page").distinct().join(broken.select("page"), "page", "left_anti")
    return broken.unionByName(differing.select("page", F.lit("IMPORT_CHANGED").alias("error")))
