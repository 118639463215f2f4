"""Stored tables: create, evolve, query, replace, cache."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom import schemas


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """S-13: create the stored tables that do not exist yet."""
    for name, ddl in schemas.TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet")


def ensure_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """S-14: add missing columns with a default."""
    return df.withColumns({n: F.lit(v) for n, v in defaults.items() if n not in df.columns})


def query(spark: SparkSession, sql: str, views: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """S-10: a parameterised query over named DataFrames."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args or {})


def append_rows(df: DataFrame, path: str) -> None:
    """Add the rows of a batch to a stored table; what is stored is not written again."""
    df.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Write ``df`` over those partitions of a stored table that it has rows of.

    ``df`` may be made from the stored table, so it is written beside it first.
    """
    spark, staged = df.sparkSession, f"{path}.next"
    df.write.mode("overwrite").parquet(staged)
    rows = spark.read.schema(df.schema).parquet(staged)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def replace_table(df: DataFrame, path: str, version: str) -> str:
    """Write the new state of a table beside the old one and return its path.

    An upsert reads the old state while it writes, so the state is never
    overwritten in place; a lost executor only repeats its tasks.
    """
    target = f"{path}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def write_cache(df: DataFrame, path: str) -> None:
    """S-9."""
    df.write.mode("overwrite").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """S-8: the cached table, or None if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
