"""Reading the given Parquet tables with column pruning left to Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Parquet scan of one table; selecting ``cols`` here makes the ReadSchema narrow."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*cols) if cols else df
