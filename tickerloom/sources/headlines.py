"""Headline lists (JSON) to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom import schemas
from tickerloom.functions.text import date_label, epoch_date

c = F.col

# Fixed value: the site that story paths belong to.
BASE_URL = "https://tr.tradingview.com"


def read_headlines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON reply per file."""
    return spark.read.schema(schemas.HEADLINES).option("multiLine", True).json(path)


def headline_rows(replies: DataFrame, as_of: Column, base: str = BASE_URL, tz: str = "UTC") -> DataFrame:
    """S-4: items with a story path; the source falls back to the provider."""
    items = replies.select(F.explode("items").alias("i")).select("i.*")
    path = F.coalesce("storyPath", F.lit(""))
    return items.filter(path != "").select(
        F.concat(F.lit(base), c("storyPath")).alias("url"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("source", "provider", F.lit("")).alias("provider"),
        F.coalesce("provider", F.lit("")).alias("provider_id"),
        F.coalesce("published", F.lit(0)).alias("published"),
        date_label(epoch_date(c("published"), as_of, tz)).alias("date_label"),
        F.coalesce("link", F.lit("")).alias("link"),
    )


def from_json_text(raw: DataFrame, column: str = "json") -> DataFrame:
    """Replies held as text."""
    return raw.select(F.from_json(column, schemas.HEADLINES).alias("r")).select("r.*")
