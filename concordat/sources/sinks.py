"""Where results go: write-once snapshots, findings for review tools, rendered fragments and bundle manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions.lexeme import fingerprint


def write_snapshot(report: DataFrame, root: str, name: str) -> None:
    """S-18: a named report, written once; a second one of the name is an error."""
    report.write.mode("errorifexists").parquet(f"{root}/name={name}")


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/name={name}")


def sarif_results(findings: DataFrame) -> DataFrame:
    """S-19: one JSON object for each finding (rule, subject, severity, file, line, message), with a partial fingerprint that survives moved lines."""
    level = F.when(F.col("severity") == "unknown", "warning").when(F.col("severity") == "error", "error").otherwise("note")
    place = F.when(F.col("file").isNotNull(), F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))))
    body = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"), F.struct(fingerprint("rule", "subject").alias("subject/v1")).alias("partialFingerprints"))
    return findings.select(fingerprint("rule", "subject").alias("id"), F.to_json(body).alias("result"))


def write_sarif(findings: DataFrame, path: str) -> None:
    """One JSON object for each line; tools that want a single file wrap the lines into ``runs[0].results``."""
    sarif_results(findings).select(F.col("result").alias("value")).write.text(path)


def fragment_lines(values: DataFrame) -> DataFrame:
    """S-20, F-37: (fragment, ord, line): bound values (fragment, ord, label, value, format) as lines of LaTeX or Markdown."""
    latex = F.col("format") == "latex"
    label = F.when(latex, F.regexp_replace("label", "_", r"\\_")).otherwise(F.regexp_replace("label", r"([_*])", r"\\$1"))
    shown = F.when(latex, F.concat(F.lit("\\ensuremath{"), "value", F.lit("}"))).otherwise(F.col("value"))
    line = F.when(latex, F.concat(label, F.lit(" & "), shown, F.lit(r" \\"))).otherwise(F.concat(F.lit("| "), label, F.lit(" | "), shown, F.lit(" |")))
    return values.select("fragment", "ord", line.alias("line"))


def write_fragments(values: DataFrame, path: str) -> None:
    """S-20: the lines of each fragment in order, in files below ``fragment=<name>``; the order of the files' names is that of the lines."""
    lines = fragment_lines(values).repartitionByRange("fragment", "ord").sortWithinPartitions("fragment", "ord")
    lines.select("fragment", F.col("line").alias("value")).write.partitionBy("fragment").text(path)


def bundle_manifest(files: DataFrame, required: DataFrame, preview: int = 4096) -> DataFrame:
    """S-21, U-10, C-18: (path, bytes, sha256, kind, preview, truncated, missing) of a bundle's files (path, content), and of required ones that it lacks."""
    text = F.decode("content", "UTF-8")
    kind = F.when(F.lower("path").rlike(r"\.(csv|tsv|json|xlsx)$"), "evidence").when(F.lower("path").rlike(r"\.(tex|md|qmd|docx|pdf)$"), "document").when(F.lower("path").rlike(r"\.(ya?ml|toml)$"), "declaration").otherwise("other")
    have = files.select("path", F.length("content").cast("long").alias("bytes"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"), kind.alias("kind"), F.substring(text, 1, preview).alias("preview"), (F.length(text) > preview).alias("truncated"), F.lit(False).alias("missing"))
    lack = required.select("path").distinct().join(files.select("path"), "path", "left_anti").withColumn("missing", F.lit(True))
    return have.unionByName(lack, allowMissingColumns=True)


# How many bindings a fragment may hold, the headings of its table in each language, and the frames of both formats.
FRAGMENT_MOST = 128
HEADINGS = {"en": ("Binding", "Value"), "zh-CN": ("绑定", "数值")}
LATEX_FRAME = ("\\begin{tabular}{lr}\n", "\\end{tabular}\n")
MARKDOWN_RULE = "| --- | ---: |\n"


def fragment_texts(specs: DataFrame, values: DataFrame) -> DataFrame:
    """S-20, C-27: (fragment, text, error): the whole text of each fragment.

    ``specs`` has fragment, format (latex or markdown), layout (value or table),
    language and path; ``values`` (fragment, ord, occurrence, rendered), rendered
    as LaTeX writes it.  A fragment holds 1 to ``FRAGMENT_MOST`` different
    occurrences, one where its layout is a value, and its path ends as its
    format does; else it has an error.  Occurrences are counted before any are
    brought together, so no fragment is larger than that.
    """
    n = values.groupBy("fragment", "occurrence").agg(F.count(F.lit(1)).alias("k")).groupBy("fragment").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("same"))
    met = specs.join(n, "fragment", "left")
    latex = F.col("format") == "latex"
    known = F.col("format").isin("latex", "markdown") & F.col("layout").isin("value", "table") & F.col("language").isin(*HEADINGS)
    wrong = (F.coalesce("n", F.lit(0)) < 1) | (F.col("n") > FRAGMENT_MOST) | (F.col("same") > 1) | ((F.col("layout") == "value") & (F.col("n") != 1))
    suffix = F.when(latex, ".tex").otherwise(".md")
    error = F.when(F.coalesce(~known, F.lit(True)), "FRAGMENT_SPEC").when(F.coalesce(wrong, F.lit(True)), "FRAGMENT_SELECTION").when(F.coalesce(~F.col("path").endswith(suffix), F.lit(True)), "FRAGMENT_EXTENSION")
    judged = met.select("fragment", "format", "layout", "language", error.alias("error"))
    plain = F.replace(F.replace("rendered", F.lit("\\%"), F.lit("%")), F.lit("\\pm"), F.lit("±"))
    shown = F.when(~latex, plain).when(F.contains("rendered", F.lit("\\pm")), F.concat(F.lit("\\ensuremath{"), "rendered", F.lit("}"))).otherwise(F.col("rendered"))
    label = F.replace("occurrence", F.lit("_"), F.lit("\\_"))
    row = F.when(latex, F.concat(label, F.lit(" & "), shown, F.lit(" \\\\\n"))).otherwise(F.concat(F.lit("| "), label, F.lit(" | "), shown, F.lit(" |\n")))
    line = F.when(F.col("layout") == "value", F.concat(shown, F.lit("\n"))).otherwise(row)
    lines = values.join(judged.where("error is null"), "fragment").select("fragment", F.struct("ord", line.alias("line")).alias("l"))
    body = lines.groupBy("fragment").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "").alias("body"))
    left, right = (F.create_map(*[F.lit(x) for language, pair in HEADINGS.items() for x in (language, pair[i])])[F.col("language")] for i in (0, 1))
    head = F.when(latex, F.concat(F.lit(LATEX_FRAME[0]), left, F.lit(" & "), right, F.lit(" \\\\\n"))).otherwise(F.concat(F.lit("| "), left, F.lit(" | "), right, F.lit(" |\n" + MARKDOWN_RULE)))
    framed = F.when(F.col("layout") == "value", F.col("body")).otherwise(F.concat(head, "body", F.when(latex, LATEX_FRAME[1]).otherwise("")))
    return judged.join(body, "fragment", "left").select("fragment", F.when(F.col("error").isNull(), framed).alias("text"), "error")
