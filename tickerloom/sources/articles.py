"""Article store and labelled sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.text import unpacked


def write_articles(articles: DataFrame, path: str, files_per_partition_salt: int = 8) -> None:
    """S-11: one folder per date and provider.

    A day's provider may hold much of the data, so its rows are spread over
    several tasks before the write.
    """
    salt = F.pmod(F.xxhash64("url"), F.lit(files_per_partition_salt))
    spread = articles.repartition("news_date", "provider", salt)
    spread.write.mode("append").partitionBy("news_date", "provider").parquet(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def split_files(files: DataFrame, key: str = "path", text: str = "value") -> DataFrame:
    """F-15: stored text files back to articles."""
    return files.select(key, F.posexplode(unpacked(F.col(text))).alias("pos", "content"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as (path, value)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def write_labelled(sentences: DataFrame, path: str) -> None:
    """S-12."""
    sentences.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
