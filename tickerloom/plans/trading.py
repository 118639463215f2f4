"""Weekly training and daily trading over the feature table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.operators import ledger, models, upsert
from tickerloom.plans.features import MIN_ROWS, feature_columns
from tickerloom.sources.bars import with_min_history

c = F.col


def weekly_training(
    features: DataFrame, company: DataFrame, stored: DataFrame, as_of: dt.date,
    force: bool = True, groups: list[str] | None = None, min_rows: int = MIN_ROWS,
    columns: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """M-3, M-4: new models of the due symbols and the status of every symbol."""
    policy = models.retrain_status(company, stored, as_of, force)
    due = features.join(policy.filter(c("status") == "train").select("symbol"), "symbol", "left_semi")
    due = with_min_history(due, min_rows)
    trained = models.train_models(due, columns or feature_columns(groups), F.lit(as_of))
    return trained, models.training_status(policy, features, trained, min_rows)


def daily_predictions(
    features: DataFrame, stored: DataFrame, company: DataFrame, prediction: DataFrame, as_of: dt.date,
    version: str = "nn_v1", min_rows: int = MIN_ROWS,
) -> DataFrame:
    """M-5, U-4: the prediction table after scoring every symbol that has a model and a long enough history."""
    models.require_models(stored)
    scored = models.score_latest(with_min_history(features, min_rows), stored, as_of).withColumns(
        {"model_version": F.lit(version), "seq": F.lit(0)}
    )
    return upsert.upsert_prediction(prediction, scored, company, F.lit(as_of).cast("timestamp"))


def daily_intents(
    prediction: DataFrame, company: DataFrame, bars: DataFrame, as_of: dt.date, suffix: str = ".IS"
) -> DataFrame:
    """L-1, L-7: the day's ordered intents with the latest price of each symbol."""
    today = ledger.predictions_on(prediction, company, as_of).withColumn("date", F.lit(as_of))
    prices = ledger.latest_price(bars, as_of).withColumn("symbol", F.concat("symbol", F.lit(suffix)))
    return ledger.trade_intents(today, suffix=suffix).join(prices, "symbol", "left")
