"""JSON-lines export / import of results (SNK-5, SNK-6, SCL-4).

Records are the DataFrame itself; JSON is only an export format. Nulls are
written explicitly so every record has every field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

JSON_OPTIONS = {"ignoreNullFields": "false"}


def to_json_lines(df: DataFrame, column: str = "json") -> DataFrame:
    """One JSON object per row."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), JSON_OPTIONS).alias(column))


def from_json_lines(df: DataFrame, schema: T.StructType | str, column: str = "json") -> DataFrame:
    """Parse a column of JSON objects back into typed columns."""
    return df.select(F.from_json(F.col(column), schema).alias("_r")).select("_r.*")


def write_json(df: DataFrame, path: str) -> None:
    """Distributed JSON-lines export (one file per partition)."""
    df.write.mode("overwrite").options(**JSON_OPTIONS).json(path)
