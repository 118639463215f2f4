"""Article scores, daily sentiment and its features; sentence scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.scores import label_weight, score_class
from tickerloom.functions.text import scored_sentences
from tickerloom.operators import timeseries as ts
from tickerloom.operators.stacks import tools

c = F.col

# A scorer adds ``label`` and ``score`` to rows with a ``sentence``.
Scorer = Callable[[DataFrame], DataFrame]


def article_sentences(news: DataFrame) -> DataFrame:
    """F-2: one row per scored sentence."""
    return news.select("news_id", F.posexplode(scored_sentences(c("content"))).alias("pos", "sentence"))


def article_scores(scored: DataFrame) -> DataFrame:
    """A-10: sum of weight times confidence over the number of non-neutral sentences."""
    w = label_weight(c("label"))
    mean = F.try_divide(F.sum(w * c("score")), F.count_if(w != 0))
    return (
        scored.groupBy("news_id")
        .agg(F.coalesce(mean, F.lit(0.0)).alias("news_ratio"))
        .withColumn("news_type", score_class(c("news_ratio")))
    )


def score_articles(news: DataFrame, scorer: Scorer) -> DataFrame:
    """Class and score of every article; 0 without scored sentences."""
    scores = article_scores(scorer(article_sentences(news)))
    return news.join(scores, "news_id", "left").fillna({"news_ratio": 0.0, "news_type": 0})


def news_of_companies(news: DataFrame, bridge: DataFrame, company: DataFrame) -> DataFrame:
    """J-1."""
    return news.join(bridge, "news_id").join(company.select("company_id", "code"), "company_id")


def daily_sentiment(news: DataFrame, bridge: DataFrame, company: DataFrame) -> DataFrame:
    """A-1: mean score and number of articles per company and day."""
    return (
        news_of_companies(news.select("news_id", "news_date", "news_ratio"), bridge, company)
        .groupBy(c("code").alias("symbol"), c("news_date").alias("date"))
        .agg(F.avg("news_ratio").alias("avg_sentiment"), F.count("news_id").alias("news_count"))
    )


SENTIMENT_WINDOWS = (7, 14, 30, 50)


def join_sentiment(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """J-4: days without trading drop out, days without news get 0."""
    return bars.join(daily, ["symbol", "date"], "left").fillna({"avg_sentiment": 0.0, "news_count": 0})


def with_sentiment(bars: DataFrame, daily: DataFrame | None) -> DataFrame:
    """The day's score and number of articles; 0 without any news."""
    if daily is None:
        return bars.withColumns({"avg_sentiment": F.lit(0.0), "news_count": F.lit(0).cast("bigint")})
    return join_sentiment(bars, daily)


def add_sentiment(bars: DataFrame, daily: DataFrame | None) -> DataFrame:
    """D-45."""
    return add_sentiment_means(with_sentiment(bars, daily))


def add_sentiment_means(df: DataFrame) -> DataFrame:
    """D-45: rolling means, also 0 while they warm up."""
    F, c = tools(df)
    mean = {
        f"sentiment_{n}d": F.coalesce(ts.roll_mean(c("avg_sentiment"), n), F.lit(0.0)) for n in SENTIMENT_WINDOWS
    }
    return df.withColumns(mean)


# -- scorers -------------------------------------------------------------------

LABELS = ["LABEL_0", "LABEL_1", "LABEL_2"]


def train_scorer(labelled: DataFrame, features: int = 1 << 14, iterations: int = 30) -> PipelineModel:
    """M-11: labelled(sentence, label 0..2) to a text classifier."""
    stages = [
        RegexTokenizer(inputCol="sentence", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+", toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        LogisticRegression(
            featuresCol="_tfidf", labelCol="label", predictionCol="_pred", probabilityCol="_prob",
            rawPredictionCol="_raw", maxIter=iterations, regParam=0.01, family="multinomial",
        ),
    ]
    return Pipeline(stages=stages).fit(labelled.select("sentence", c("label").cast("double")))


def model_scorer(model: PipelineModel) -> Scorer:
    """M-10: label and confidence of a trained classifier."""

    def score(sentences: DataFrame) -> DataFrame:
        out = model.transform(sentences)
        names = F.array(*[F.lit(n) for n in LABELS])
        return out.select(
            *[c(n) for n in sentences.columns],
            F.get(names, c("_pred").cast("int")).alias("label"),
            F.array_max(vector_to_array("_prob")).alias("score"),
        )

    return score


def udf_scorer(load: Callable[[], Callable]) -> Scorer:
    """M-10: an external model. ``load`` runs once per worker and returns a
    function from a list of sentences to lists of labels and confidences."""

    @F.pandas_udf("struct<label: string, score: double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = load()
        for batch in batches:
            labels, scores = predict(batch.tolist())
            yield pd.DataFrame({"label": labels, "score": scores})

    def score(sentences: DataFrame) -> DataFrame:
        return sentences.withColumn("_s", run("sentence")).select(*sentences.columns, "_s.label", "_s.score")

    return score
