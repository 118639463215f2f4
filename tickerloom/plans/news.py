"""From fetched pages to stored articles, links and scores."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions import html, text
from tickerloom.operators import matching, sentiment, upsert
from tickerloom.sources.tables import read_cache

c = F.col

MAX_AGE_DAYS = 10


def recent(articles: DataFrame, as_of: dt.date, days: int = MAX_AGE_DAYS) -> DataFrame:
    """P-6."""
    return articles.filter(c("news_date") >= F.lit(as_of - dt.timedelta(days=days)))


def extract_articles(pages: DataFrame, as_of: Column) -> DataFrame:
    """F-6 to F-14: headline rows with ``html`` to articles.

    pages(seq, url, title, provider, provider_id, date_label, link, html); a page
    without a title falls back to the headline.
    """
    listed = F.coalesce(F.to_date("date_label", "yyyy.MM.dd"), as_of)
    df = pages.withColumn("_f", html.article(c("html")))
    found = c("_f.title").isNotNull()
    content = F.when(found, html.article_text(c("_f"))).otherwise(
        text.fallback_content(c("title"), c("provider"), c("link"))
    )
    df = df.withColumn("content", text.strip_disclaimer(content))
    # A page without a date counts as published today, as does a date in no known format.
    dated = F.when(found, text.news_date(c("_f.published"), as_of)).otherwise(listed)
    return df.select(
        "seq",
        "url",
        dated.alias("news_date"),
        text.provider_or_id(text.provider(text.packed(c("content"))), c("provider_id")).alias("provider"),
        "content",
    )


def with_matches(articles: DataFrame, matches: DataFrame) -> DataFrame:
    """P-7: articles with at least one match.

    Matches are stored in few bytes, so by the size of its files Spark would send a table of millions to the driver.
    """
    return articles.join(matches.select("news_id").hint("merge"), "news_id", "left_semi")


@dataclass
class Store:
    """The news tables; ``new_news`` and ``new_links`` are the rows that a batch adds to them."""

    company: DataFrame
    news: DataFrame
    bridge: DataFrame
    new_news: DataFrame | None = None
    new_links: DataFrame | None = None


# Stored rows come before the rows of a batch.
_BEFORE = 1 << 40


def unstored_articles(articles: DataFrame, news: DataFrame) -> DataFrame:
    """F-25: articles whose text the stored files of their day and provider do not hold yet."""
    text = ["news_date", "provider", "content"]
    if not set(text) <= set(news.columns):
        return upsert.drop_stored_texts(articles)
    days = articles.select("news_date").distinct()
    stored = news.join(days, "news_date", "left_semi").select((c("news_id") - _BEFORE).alias("seq"), *text)
    new = upsert.drop_stored_texts(stored.unionByName(articles.select(c("seq").cast("bigint").alias("seq"), *text)))
    return articles.join(new.select("seq").hint("merge"), "seq", "left_semi")


def process_news(
    articles: DataFrame, companies: DataFrame, scorer: sentiment.Scorer, store: Store, as_of: dt.date, now: Column,
    folder: str,
) -> Store:
    """M-12: match, score and store a batch of articles(seq, url, news_date, provider, content).

    Old articles, texts that are stored already and unmatched articles are
    dropped before scoring. The links of an article whose url is already stored
    are dropped with it. Matches, scores and the tables are written once to
    ``folder``, a folder that all executors share, and read from there; the
    caller appends ``new_news`` and ``new_links`` and keeps the new ``company``.
    """

    def staged(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    fresh = unstored_articles(recent(articles, as_of), store.news).withColumn("url", F.coalesce("url", F.lit("")))
    keyed = staged(fresh.withColumn("news_id", c("seq")), "articles")
    exact = staged(matching.exact_matches(keyed, companies), "exact")
    matches = exact.unionByName(staged(matching.fuzzy_matches(keyed, companies, exclude=exact), "fuzzy"))
    scored = sentiment.score_articles(with_matches(keyed, matches), scorer)
    rows = staged(
        scored.select(
            "seq", "url", "news_date", F.lit("tradingview").alias("website"), "provider", "content",
            "news_type", "news_ratio", now.alias("created_at"),
        ),
        "scored",
    )
    names = matches.select(c("news_id").alias("seq"), "code", F.coalesce("name", "code").alias("name"))
    company = staged(upsert.upsert_company(store.company, names), "company")
    new = staged(upsert.new_news(store.news, rows), "news")
    # Only the article that was inserted for a url passes its links on.
    first = upsert.keep_one(rows.select("url", "seq"), ["url"], [c("seq")])
    inserted = first.join(new.select("url", "news_id").hint("merge"), "url")
    links = (
        names.join(inserted.select("seq", "news_id").hint("merge"), "seq")
        .join(company.select("code", "company_id"), "code")
        .select("news_id", "company_id")
    )
    links = staged(upsert.new_links(store.bridge, links), "links")
    return Store(
        company, store.news.unionByName(new, allowMissingColumns=True), store.bridge.unionByName(links), new, links
    )


COMPANY = "company_id bigint, code string, name string"
NEWS = (
    "news_id bigint, url string, news_date date, website string, provider string, content string, "
    "news_type int, news_ratio double, created_at timestamp"
)
LINKS = "news_id bigint, company_id bigint"


def ingest(folder: str, companies: DataFrame, scorer: sentiment.Scorer, as_of: dt.date, now: Column):
    """ST-1: what the ingest stream does with a batch: run the article pipeline and add its rows to the tables.

    Each batch has its own folder in each table, so a repeated batch replaces
    its first attempt and reads only the batches before.
    """

    def before(spark, name: str, schema: str, number: int) -> DataFrame:
        rows = read_cache(spark, f"{folder}/{name}")
        if rows is None:
            return spark.createDataFrame([], f"{schema}, batch int")
        return rows.filter(c("batch") < number)

    def write_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        company = before(spark, "company", COMPANY, number)
        company = company.filter(c("batch") == company.agg(F.max("batch")).scalar()).drop("batch")
        news, links = (before(spark, n, s, number).drop("batch") for n, s in (("news", NEWS), ("links", LINKS)))
        out = process_news(batch, companies, scorer, Store(company, news, links), as_of, now, f"{folder}/work-{number}")
        for name, rows in (("company", out.company), ("news", out.new_news), ("links", out.new_links)):
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return write_batch
