"""Evidence scans: declared text columns, typed cell by cell, with the first error of a source failing all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.functions.lexeme import sha256, typed_gate

CORRUPT = "_malformed"


def scan_delimited(spark: SparkSession, path: str, columns: list[str], separator: str = ",") -> DataFrame:
    """S-01, S-02, P-05: declared columns as text, with ``_malformed`` for short or long rows and ``_path``.

    ``columns`` is the header as it stands in the file; use ``header_error``
    first.  A quoted cell may hold line feeds.
    """
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.csv(path, schema=schema, sep=separator, header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, quote='"', escape='"', multiLine=True, emptyValue="", nullValue="\u0000")
    return rows.withColumn("_path", F.col("_metadata.file_path"))


def header_error(spark: SparkSession, path: str, declared: list[str], separator: str = ",") -> str | None:
    """P-03, P-04: why the first line can't serve as header, or None."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return "MISSING_HEADER"
    names = [n.strip('"') for n in first[0][0].lstrip("﻿").split(separator)]
    if len(set(names)) != len(names):
        return "DUPLICATE_HEADER"
    return "MISSING_COLUMN" if set(declared) - set(names) else None


def header(spark: SparkSession, path: str, separator: str = ",") -> list[str]:
    return [n.strip('"') for n in spark.read.text(path).limit(1).collect()[0][0].lstrip("﻿").split(separator)]


def typed(rows: DataFrame, contract: dict[str, str], blank_is_missing: bool = False) -> DataFrame:
    """S-01, S-02, P-01, P-03: the declared columns, each gated, with ``_error`` the row's first error.

    With ``blank_is_missing`` (tab-separated files) an empty cell of another
    type than string is missing; otherwise an empty number is an error.  A
    missing value is no error of the source.
    """
    malformed = F.col(CORRUPT).isNotNull() if CORRUPT in rows.columns else F.lit(False)
    gates, errors = {}, [F.when(malformed, "MALFORMED_ROW")]
    for c, kind in contract.items():
        # An unquoted empty cell is read as null.
        cell = F.coalesce(F.col(c).cast("string"), F.lit(""))
        if blank_is_missing and kind != "string":
            cell = F.when(cell != "", cell)
        gate = typed_gate(cell, kind)
        gates[c] = F.when(cell.isNotNull(), gate["value"])
        errors.append(F.when(cell.isNotNull(), gate["error"]))
    keep = [c for c in rows.columns if c not in contract and c != CORRUPT]
    return rows.select(*[v.alias(c) for c, v in gates.items()], F.coalesce(*errors).alias("_error"), *keep)


def health(rows: DataFrame, source: str, key: list[str]) -> DataFrame:
    """A-08, A-23: (source, error) with the one error that fails the source, or no row.

    A bad cell or row comes before a repeated or incomplete key.
    """
    from concordat.operators.metrics import duplicate_keys

    cells = rows.where("_error is not null").agg(F.min("_error").alias("error")).where("error is not null").select("error", F.lit(0).alias("o"))
    keys = duplicate_keys(rows, key).agg(F.min("error").alias("error")).where("error is not null").select("error", F.lit(1).alias("o"))
    return cells.unionByName(keys).agg(F.min_by("error", "o").alias("error")).where("error is not null").select(F.lit(source).alias("source"), "error")


# -- JSON -----------------------------------------------------------------

# 39 or more digits, a point counted as one: rather too many texts to the exact lane than too few.
_LONG_NUMBER = r'(?<!["\w.])-?[0-9][0-9.]{38}'


def scan_json(documents: DataFrame, text: str = "text") -> DataFrame:
    """S-03: adds ``value`` (VARIANT), ``json_error`` and ``needs_exact``.

    Duplicate keys and NaN or Infinity are refused by the parser.  A number of
    more than 38 digits would be rounded, so such texts are marked for the
    exact lane.
    """
    value = F.try_parse_json(F.col(text))
    return documents.withColumns({"value": value, "json_error": F.when(value.isNull(), "JSON_INVALID"), "needs_exact": F.coalesce(F.col(text).rlike(_LONG_NUMBER), F.lit(False))})


def pointer_path(pointer: str) -> str:
    """F-40: an RFC 6901 pointer as a variant path; digits are taken as an array index."""
    if pointer == "":
        return "$"
    if not pointer.startswith("/"):
        raise ValueError("a pointer begins with /")
    out = "$"
    for part in pointer[1:].split("/"):
        name = part.replace("~1", "/").replace("~0", "~")
        out += f"[{name}]" if name.isdigit() else "['" + name.replace("'", "\\'") + "']"
    return out


def json_pointer(value: Column, pointer: str) -> Column:
    """F-40: (lexeme, error) at a pointer of a VARIANT; a digit part is tried as an index, then as a key."""
    path = pointer_path(pointer)
    keyed = "$" + "".join("['" + p.replace("~1", "/").replace("~0", "~").replace("'", "\\'") + "']" for p in pointer.split("/")[1:])
    got = F.coalesce(F.try_variant_get(value, path, "variant"), F.try_variant_get(value, keyed, "variant"))
    return F.struct(got.cast("string").alias("lexeme"), F.when(got.isNull() | F.is_variant_null(got), "MISSING_VALUE").alias("error"))


def escape_pointer(name: Column) -> Column:
    """F-46."""
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def json_leaves(documents: DataFrame, depth: int = 8) -> DataFrame:
    """S-11, F-41, F-44: (doc_id, pointer, kind, lexeme) of all scalar leaves; deeper containers come as one leaf of kind container."""
    level = scan_json(documents).where("value is not null").select("doc_id", F.lit("").alias("pointer"), F.col("value").alias("v"))
    out = None
    for _ in range(depth + 1):
        kind = F.schema_of_variant("v")
        marked = level.withColumn("kind", kind)
        container = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        leaf = marked.where(~container).select("doc_id", "pointer", "kind", F.col("v").cast("string").alias("lexeme"))
        out = leaf if out is None else out.unionByName(leaf)
        level.createOrReplaceTempView("_concordat_json_level")
        deeper = marked.where(container)
        deeper.createOrReplaceTempView("_concordat_json_level")
        level = documents.sparkSession.sql("select doc_id, concat(pointer, '/', coalesce(replace(replace(e.key, '~', '~0'), '/', '~1'), cast(e.pos as string))) as pointer, e.value as v from _concordat_json_level, lateral variant_explode(v) as e")
    rest = level.select("doc_id", "pointer", F.lit("container").alias("kind"), F.col("v").cast("string").alias("lexeme"))
    return out.unionByName(rest)


# -- records and raw bytes ------------------------------------------------


def scan_records(records: DataFrame, contract: dict[str, str]) -> DataFrame:
    """S-04: portable rows (values map, snapshot, pointers map) as declared columns, with ``_error`` where a row breaks the contract."""
    declared = F.array_sort(F.array(*map(F.lit, contract)))
    same = F.array_sort(F.map_keys("values")) == declared
    cells = {c: F.try_element_at("values", F.lit(c)) for c in contract}
    errors = [F.when(~same, "RECORD_CONTRACT"), *[F.when(v.isNotNull(), typed_gate(v, contract[c])["error"]) for c, v in cells.items()]]
    return records.select(*[v.alias(c) for c, v in cells.items()], "snapshot", "pointers", F.coalesce(*errors).alias("_error"))


def content_identities(spark: SparkSession, path: str, suffixes: list[str] | None = None, pruned: str = r"/(\.git|node_modules|__pycache__)/") -> DataFrame:
    """S-08, S-15, S-16: (path, bytes, sha256) of all files below a folder, pruned folders aside."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.col("path").rlike(pruned))
    if suffixes:
        files = files.where(F.lower("path").rlike(r"\.(" + "|".join(s.lstrip(".") for s in suffixes) + ")$"))
    return files.select("path", F.col("length").alias("bytes"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"))


def verify_snapshots(snapshots: DataFrame) -> DataFrame:
    """S-08: snapshots (content, sha256) whose bytes no longer have their hash."""
    return snapshots.where(sha256("content") != F.col("sha256"))


def summary(rows: DataFrame, key: list[str], offset: int = 0, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """S-10, T-02: (one row with record_count and columns; one page of rows in key order with ``total`` and ``next_offset``)."""
    total = rows.agg(F.count(F.lit(1)).alias("record_count"), F.array(*map(F.lit, rows.columns)).alias("columns"))
    return total, page(rows, key, offset, limit)


def page(rows: DataFrame, key: list[str], offset: int, limit: int) -> DataFrame:
    """T-02: one page in a total order, with the total number and where the next page starts (null at the end)."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    cut = rows.orderBy(*key).offset(offset).limit(limit)
    end = offset + limit
    return cut.join(F.broadcast(total), F.lit(True)).withColumn("next_offset", F.when(F.col("total") > end, F.lit(end)))
