"""One table whose last column is the label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan_tabular_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Header CSV; types are inferred unless ``schema`` spares the extra pass."""
    reader = spark.read.option("header", True).option("escape", '"')
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)
