"""Market and news tables derived from the given parquet files."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.scores import signal
from tickerloom.functions.text import words
from tickerloom.operators.macro import to_wide, us_series
from tickerloom.operators.sentiment import daily_sentiment, score_articles
from tickerloom.sources.bars import bars_from_ticks

c = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_order():
    """(orderkey, linenumber, partkey, price in cents, quantity) as one number.

    A number keeps the first/last aggregates in a hash aggregate; a struct would
    make Spark sort the lines on both sides of the shuffle.
    """
    line = (c("l_orderkey") * 10 + c("l_linenumber")).cast("decimal(14,0)")
    price = (F.round(c("l_extendedprice") * 100).cast("bigint") * 1000 + c("l_quantity").cast("bigint"))
    low = c("l_partkey").cast("decimal(10,0)") * F.lit(Decimal(10**13)) + price.cast("decimal(13,0)")
    return (line * F.lit(Decimal(10**23)) + low).cast("decimal(38,0)")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity",
               "l_discount", "l_tax"]
    li = table(spark, sf_dir, "lineitem").select(*columns)
    price = c("l_extendedprice") / c("l_quantity")
    return li.select(
        c("l_suppkey").cast("string").alias("symbol"),
        c("l_shipdate").cast("date").alias("date"),
        line_order().alias("seq"),
        price.alias("open_tick"),
        (price * (1 - c("l_discount")) * (1 + c("l_tax"))).alias("close_tick"),
        (price * (1 - c("l_discount"))).alias("low_tick"),
        (price * (1 + c("l_tax"))).alias("high_tick"),
        c("l_quantity").alias("quantity"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir))


# -- macro ---------------------------------------------------------------------------

FX = {
    "1-URGENT": "TP_DK_USD_A_YTL",
    "2-HIGH": "TP_DK_USD_S_YTL",
    "3-MEDIUM": "TP_DK_EUR_A_YTL",
    "4-NOT SPECIFIED": "TP_DK_EUR_S_YTL",
    "5-LOW": "TP_DK_GBP_A_YTL",
}
US = {"F": "Fed Faiz Oranı", "O": "10Y Tahvil Faizi", "P": "2Y Tahvil Faizi"}


def macro_long(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """Mean order value per day and class."""
    orders = table(spark, sf_dir, "orders").select(
        c(by).alias("series"), c("o_orderdate").cast("date").alias("date"), "o_totalprice"
    )
    return orders.groupBy("series", "date").agg(F.avg("o_totalprice").alias("value"))


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_wide(macro_long(spark, sf_dir, "o_orderpriority"), FX)


def us(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return us_series(macro_long(spark, sf_dir, "o_orderstatus"), US, **options)


# -- news ------------------------------------------------------------------------------

FIRST_DAY = "1995-01-02"


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        c("doc_id").alias("news_id"),
        F.concat(F.lit("http://x/"), c("doc_id").cast("string")).alias("url"),
        F.date_add(F.lit(FIRST_DAY).cast("date"), (c("doc_id") % 2500).cast("int")).alias("news_date"),
        F.lit("tradingview").alias("website"),
        c("source").alias("provider"),
        c("text").alias("content"),
        "lang",
    )


def company(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        c("s_suppkey").alias("company_id"),
        c("s_suppkey").cast("string").alias("code"),
        c("s_name").alias("name"),
        c("s_acctbal"),
        c("s_nationkey"),
    )


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article names two companies, of as many as there are."""
    ids = table(spark, sf_dir, "documents").select(c("doc_id").alias("news_id"))
    n = company(spark, sf_dir).agg(F.count("*")).scalar()
    links = ids.select("news_id", F.explode(F.array(c("news_id") % n, (c("news_id") * 31 + 7) % n)).alias("company_id"))
    return links.distinct().join(company(spark, sf_dir).select("company_id"), "company_id", "left_semi").select(
        "news_id", "company_id"
    )


def hash_scorer(sentences: DataFrame) -> DataFrame:
    """Label and confidence from the sentence's digest."""

    def byte(pos):
        return F.conv(F.substring(F.md5("sentence"), pos, 2), 16, 10).cast("int")

    return sentences.withColumns(
        {
            "label": F.concat(F.lit("LABEL_"), (byte(1) % 3).cast("string")),
            "score": byte(3) / F.lit(255.0),
        }
    )


def scored_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_articles(news(spark, sf_dir), hash_scorer)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_sentiment(scored_news(spark, sf_dir), bridge(spark, sf_dir), company(spark, sf_dir))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies to match: first word (code) and first two words (name) of the benchmark items."""
    w = words(F.upper(c("text")))
    items = table(spark, sf_dir, "benchmark").select(
        F.regexp_extract(F.get(w, F.lit(0)), r"([\p{L}\p{N}_]+)", 1).alias("code"),
        F.array_join(F.slice(w, 1, 2), " ").alias("name"),
        "item_id",
    )
    return items.filter(c("code") != "").groupBy("code").agg(F.min_by("name", "item_id").alias("name"))


def upper_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(c("doc_id").alias("news_id"), F.upper("text").alias("content"))


# -- predictions ---------------------------------------------------------------------------

def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per bar, from the day's move."""
    p = 0.5 + 2 * (c("close") - c("open")) / c("open")
    return bars(spark, sf_dir).select(
        c("symbol").cast("bigint").alias("company_id"),
        c("date").alias("prediction_date"),
        signal(p).alias("signal"),
        p.alias("probability"),
        F.lit("nn_v1").alias("model_version"),
        F.lit(None).cast("double").alias("model_auc"),
        c("date").cast("timestamp").alias("created_at"),
    )
