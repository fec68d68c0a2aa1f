"""Document corpora, notebooks and records that stand beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions.lexeme import fingerprint, sha256


def corpus(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """S-12: (file, text, sha256, format) of all documents below a folder; a file read twice is an error of ``repeated``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    formats = F.create_map(*[F.lit(x) for x in ("tex", "latex", "md", "markdown", "markdown", "markdown", "qmd", "quarto", "ipynb", "notebook", "txt", "text")])
    chosen = files.where(kind.isin(*[s.lstrip(".") for s in suffixes]))
    return chosen.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("text"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"), F.coalesce(formats[kind], kind).alias("format"))


def repeated(documents: DataFrame) -> DataFrame:
    """S-12: files that come more than once."""
    return documents.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("file", F.lit("DUPLICATE_DOCUMENT").alias("error"))


def notebook_cells(notebooks: DataFrame) -> DataFrame:
    """S-14: (path, ord, cell_id, source_hash, outputs_hash, execution_count, status, error) of (path, text) in notebook format 4.

    Statuses: not_code, unexecuted, saved_error, unsupported_output,
    saved_outputs.  Cells without an id, or with one used twice, are errors.
    """
    schema = "struct<cells array<struct<id string, cell_type string, source string, outputs array<struct<output_type string, data map<string,string>, text string>>, execution_count bigint>>>"
    rows = notebooks.select("path", F.posexplode(F.from_json("text", schema)["cells"]).alias("ord", "c"))
    kinds = F.transform(F.coalesce("c.outputs", F.array()), lambda o: o["output_type"])
    known = F.array(*map(F.lit, ("stream", "display_data", "execute_result", "error")))
    status = (
        F.when(F.col("c.cell_type") != "code", "not_code")
        .when(F.col("c.execution_count").isNull(), "unexecuted")
        .when(F.array_contains(kinds, "error"), "saved_error")
        .when(F.size(F.array_except(kinds, known)) > 0, "unsupported_output")
        .otherwise("saved_outputs")
    )
    n = rows.groupBy("path", F.col("c.id").alias("cell_id")).agg(F.count(F.lit(1)).alias("same"))
    out = rows.select("path", "ord", F.col("c.id").alias("cell_id"), sha256(F.coalesce("c.source", F.lit(""))).alias("source_hash"), sha256(F.to_json(F.col("c.outputs"))).alias("outputs_hash"), F.col("c.execution_count").alias("execution_count"), status.alias("status"))
    met = out.join(n, (out.path == n.path) & out.cell_id.eqNullSafe(n.cell_id)).select(out["*"], "same")
    return met.withColumn("error", F.when(F.col("cell_id").isNull(), "CELL_ID_MISSING").when(F.col("same") > 1, "CELL_ID_DUPLICATE")).drop("same")


def reviewed_records(records: DataFrame, payload: list[str], declared: str = "fingerprint") -> DataFrame:
    """S-17, S-22: adds ``error`` (RECORD_HASH) where a record's own fingerprint isn't that of its payload."""
    return records.withColumn("error", F.when(~F.col(declared).eqNullSafe(fingerprint(*payload)), "RECORD_HASH"))


def companions(documents: DataFrame, references: DataFrame) -> DataFrame:
    """C-22: documents that may be removed: those that nothing refers to."""
    return documents.join(references.select("file").distinct(), "file", "left_anti")
