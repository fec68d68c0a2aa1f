"""Declarations as small tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def declared(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of a declaration as a local relation, whose size Spark knows."""
    struct = T._parse_datatype_string(schema)
    table = pa.Table.from_pylist([dict(zip(struct.names, r, strict=True)) for r in rows], to_arrow_schema(struct))
    return spark.createDataFrame(table, struct)
