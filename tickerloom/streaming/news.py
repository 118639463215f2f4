"""Incremental ingest of articles and running daily sentiment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

c = F.col

ARTICLES = (
    "url string, published timestamp, symbol string, provider string, content string, score double"
)
LATENESS = "10 days"


def article_stream(spark: SparkSession, path: str, schema: str = ARTICLES, files_per_batch: int = 100) -> DataFrame:
    """ST-1: new files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """ST-2, ST-3: the first article per url; articles older than the watermark are dropped.

    A missing url counts as the empty url. The state holds the urls of the last
    ``lateness`` only and is spread over the tasks by url.
    """
    keyed = stream.withColumn("url", F.coalesce("url", F.lit("")))
    return keyed.withWatermark("published", lateness).dropDuplicatesWithinWatermark(["url"])


def running_sentiment(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """ST-4: mean score and number of articles per symbol and day, updated as they arrive."""
    return (
        stream.withWatermark("published", lateness)
        .groupBy(F.window("published", "1 day").alias("w"), "symbol")
        .agg(F.avg("score").alias("avg_sentiment"), F.count("url").alias("news_count"))
        .select("symbol", F.to_date(c("w.start")).alias("date"), "avg_sentiment", "news_count")
    )


def start_ingest(
    stream: DataFrame, write_batch: Callable[[DataFrame, int], None], checkpoint: str,
    every: str | None = "30 minutes",
) -> StreamingQuery:
    """ST-1: hand each batch to ``write_batch``; ``every=None`` drains the source and stops.

    ``write_batch`` gets the batch number, so that a repeated batch can replace
    its first attempt.
    """
    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()
