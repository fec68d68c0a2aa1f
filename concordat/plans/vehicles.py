"""The driver's tables seen as evidence, bindings, documents, histories and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"model": "string", "split": "string", "seed": "integer", "order_key": "integer", "discount": "decimal", "quantity": "decimal"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as experiment results; all columns as text, as a scan gives them."""
    rows = table(spark, sf_dir, "lineitem")
    number = "decimal(18,2)"
    return rows.select(
        F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("split"),
        F.col("l_linenumber").cast("string").alias("seed"),
        F.col("l_orderkey").cast("string").alias("order_key"),
        F.col("l_discount").cast(number).cast("string").alias("discount"),
        F.col("l_quantity").cast(number).cast("string").alias("quantity"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation, customer as a dependency graph: edges (src, dst) from the part to what it belongs to."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    return n.unionByName(c)
