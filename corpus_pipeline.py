"""From raw documents to token ids: five stages, each of which works on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  Between stages the rows are written
as Parquet in the shared scratch folder and read again, so a lost executor
costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm.common import Scratch, table
from concordat.llm.decontaminate import decontaminate
from concordat.llm.near_dedup import deduplicate
from concordat.llm.pieces import encode_and_decode
from concordat.llm.quality_rules import quality_rules
from concordat.llm.queries import tokenizer_path
from concordat.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that many documents of a host share, and drops documents that fail a rule or are mostly such lines."""
    return quality_rules(docs, clean=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near copies (5-word shingles, similarity 0.8)."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of ``benchmark``."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; drops nothing."""
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text with each piece's end in the source bytes, and whether decoding gives the text back.

    A piece starts where the one before it ends.  The round trip differs only
    for texts that hold the space mark itself.
    """
    coded = encode_and_decode(docs, tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "ends", F.length("decoded").cast("long").alias("n_decoded_chars"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret scan", secrets),
    ("tokens", tokens),
]

#: Iterated links, a forest and merges are beyond SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, name.replace(" ", "-"))
    return docs
