"""Filtered, projected scans of the logical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filingscope import schemas


def load(spark: SparkSession, path: str, tables: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Parquet tables under ``path`` by name, with their declared schemas."""
    names = tables or tuple(schemas.BY_TABLE)
    return {n: spark.read.schema(schemas.BY_TABLE[n]).parquet(f"{path.rstrip('/')}/{n}") for n in names}


def save_by_source(df: DataFrame, path: str, column: str = "source") -> None:
    """Replace only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
