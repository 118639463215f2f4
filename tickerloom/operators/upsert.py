"""Writes with conflict rules, as joins that return the new table.

``new_news``, ``new_links`` and ``changed_predictions`` give what a batch has to
write: rows to append, or the partitions to replace (see ``sources.tables``). The
functions beside them return the table after the write. New ids continue after
the greatest stored id. No function starts a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.ranks import number_rows

c = F.col


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order, as a partial aggregate."""
    rest = [n for n in df.columns if n not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    row = F.struct(*[c(n) for n in rest])
    return df.groupBy(*keys).agg(F.min_by(row, rank).alias("_r")).select(
        *[c(n) if n in keys else c(f"_r.{n}").alias(n) for n in df.columns]
    )


def _last_id(df: DataFrame, name: str) -> Column:
    return F.coalesce(df.agg(F.max(name)).scalar(), F.lit(0))


def upsert_company(company: DataFrame, incoming: DataFrame) -> DataFrame:
    """U-1: incoming(seq, code, name); the latest name wins and the id stays.

    New companies are numbered by their first seq, then code, so the ids do not depend on how the rows are spread.
    """
    latest = incoming.groupBy("code").agg(
        F.max(F.struct("seq", "name"))["name"].alias("_name"), F.min("seq").alias("seq")
    )
    updated = (
        company.join(latest.drop("seq"), "code", "left")
        .withColumn("name", F.coalesce("_name", "name"))
        .drop("_name")
    )
    fresh = latest.join(company.select("code"), "code", "left_anti").withColumnRenamed("_name", "name")
    fresh = number_rows(fresh, "company_id", ["seq", "code"], _last_id(company, "company_id")).drop("seq")
    return updated.select(company.columns).unionByName(fresh, allowMissingColumns=True)


def new_news(news: DataFrame, incoming: DataFrame) -> DataFrame:
    """U-2: the rows to append: those whose url is not stored; the first of equal urls (by seq) wins.

    A missing url counts as the empty url. Of the stored table only the urls are read.
    """
    rows = incoming.withColumn("url", F.coalesce("url", F.lit("")))
    first = keep_one(rows, ["url"], [c("seq")])
    fresh = first.join(news.select("url").hint("merge"), "url", "left_anti")
    return number_rows(fresh, "news_id", "seq", _last_id(news, "news_id")).drop("seq")


def insert_news(news: DataFrame, incoming: DataFrame) -> DataFrame:
    """U-2: the table after the insert."""
    return news.unionByName(new_news(news, incoming), allowMissingColumns=True)


LINK = ["news_id", "company_id"]


def new_links(bridge: DataFrame, incoming: DataFrame) -> DataFrame:
    """U-3: the links to append: those that are not stored, once each."""
    return incoming.select(*LINK).dropDuplicates(LINK).join(bridge.select(*LINK).hint("merge"), LINK, "left_anti")


def link_news(bridge: DataFrame, incoming: DataFrame) -> DataFrame:
    """U-3: the table after insert or ignore on (news_id, company_id)."""
    return bridge.select(*LINK).unionByName(new_links(bridge, incoming))


PREDICTION = ["company_id", "prediction_date", "model_version"]


def changed_predictions(prediction: DataFrame, incoming: DataFrame, company: DataFrame, now: Column) -> DataFrame:
    """U-4: all rows, stored and new, of the days that ``incoming`` touches; unknown companies are skipped.

    incoming(seq, code, prediction_date, signal, probability, model_version,
    model_auc); of equal keys the last by seq wins. Written rows get ``now``.
    The result replaces these days' partitions, no other day is read beyond its date.
    """
    known = incoming.join(company.select("company_id", "code"), "code").drop("code")
    rows = known.withColumns({"created_at": now, "_age": (-c("seq")).cast("bigint")}).drop("seq")
    days = rows.select("prediction_date").distinct()
    stored = prediction.join(days, "prediction_date", "left_semi").withColumn("_age", F.lit(1).cast("bigint"))
    return keep_one(stored.select(*rows.columns).unionByName(rows), PREDICTION, [c("_age")]).select(*prediction.columns)


def upsert_prediction(prediction: DataFrame, incoming: DataFrame, company: DataFrame, now: Column) -> DataFrame:
    """U-4: the table after the upsert on (company, date, model version)."""
    changed = changed_predictions(prediction, incoming, company, now)
    days = changed.select("prediction_date").distinct()
    return prediction.join(days, "prediction_date", "left_anti").select(*prediction.columns).unionByName(changed)


def update_by_key(df: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """U-5: overwrite columns of the rows whose key is in ``updates`` (unique keys)."""
    names = [n for n in updates.columns if n != key]
    side = updates.select(key, F.lit(True).alias("_hit"), *[c(n).alias(f"_new_{n}") for n in names])
    out = df.join(side, key, "left")
    new = {n: F.when(c("_hit"), c(f"_new_{n}")).otherwise(c(n)) for n in names}
    return out.withColumns(new).select(*df.columns)


def update_status(df: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """U-5: which updates found a row."""
    keys = df.select(key).distinct().withColumn("_hit", F.lit(True))
    return updates.join(keys, key, "left").withColumn(
        "status", F.when(c("_hit"), "matched").otherwise("unmatched")
    ).drop("_hit")


def cascade(bridge: DataFrame, news: DataFrame, company: DataFrame) -> DataFrame:
    """J-6: links whose article and company still exist."""
    return bridge.join(news.select("news_id"), "news_id", "left_semi").join(
        company.select("company_id"), "company_id", "left_semi"
    )


def drop_stored_texts(articles: DataFrame) -> DataFrame:
    """F-25: drop articles whose text a date/provider file already holds.

    articles(seq, news_date, provider, content), written in the order of seq.
    A stored article ends with the separator line, so a text is already in the
    file exactly when an earlier article of the file ends with it (texts are
    free of the separator line); an empty text is in every file that is not new.
    Only hashes are shuffled: of the text, and of its endings of each power of
    two. Texts meet through the ending of the greatest power that fits the
    shorter one; only then the longer text is read again, for the hash of an
    ending as long as the shorter text.
    """
    group = ["news_date", "provider"]
    # A missing date or provider is a group of its own.
    keys = [F.coalesce(c(g).cast("string"), F.lit("\0")).alias(g) for g in group]
    texts = articles.select("seq", *keys, F.coalesce("content", F.lit("")).alias("content"))

    def ending(n: Column) -> Column:
        return F.xxhash64(F.substring(c("content"), F.length("content") - n + 1, n))

    powers = F.transform(
        F.sequence(F.lit(0), F.floor(F.log2(F.length("content"))).cast("int")),
        lambda i: F.pow(F.lit(2.0), i).cast("int"),
    )
    ends = F.transform(powers, lambda k: F.struct(k.alias("k"), ending(k).alias("end")))
    marks = texts.select(
        "seq", *group, F.length("content").alias("len"), F.sha2("content", 256).alias("hash"),
        F.when(F.length("content") > 0, ends).otherwise(F.array()).alias("ends"),
    )
    unique = keep_one(marks, [*group, "hash"], [c("seq")])
    full = unique.filter(c("len") > 0)
    short = full.select(*group, F.inline(F.slice("ends", -1, 1)), c("len").alias("n")).distinct()
    longer = full.select("seq", *group, "len", F.inline("ends"))
    hits = longer.join(short, [*group, "k", "end"]).filter(c("n") < c("len")).select("seq", "n").distinct()
    inside = hits.join(texts, "seq").select(
        *group, F.sha2(F.substring(c("content"), F.length("content") - c("n") + 1, c("n")), 256).alias("hash"), "seq"
    )
    seen = inside.groupBy(*group, "hash").agg(F.min("seq").alias("_seen"))
    first = unique.groupBy(*group).agg(F.min("seq").alias("_first"))
    kept = (
        unique.select("seq", *group, "hash", "len")
        .join(seen, [*group, "hash"], "left")
        .join(first, group)
        .filter((c("_seen").isNull() | (c("_seen") > c("seq"))) & ((c("len") > 0) | (c("seq") == c("_first"))))
    )
    return articles.join(kept.select("seq").hint("merge"), "seq", "left_semi")
