"""From predictions to trades: intents, prices, sizes, valuation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.scores import action
from tickerloom.functions.text import ticker

c = F.col

# Units and budget of one trade, days a price stays usable.
TRADE_UNIT = 4
TRADE_BUDGET = 10_000.0
PRICE_DAYS = 5


def predictions_on(prediction: DataFrame, company: DataFrame, date: dt.date, version: str = "nn_v1") -> DataFrame:
    """J-2, T-2: predictions of a day with company codes, most probable first."""
    day = prediction.filter((c("prediction_date") == F.lit(date)) & (c("model_version") == version))
    return (
        day.join(company.select("company_id", "code"), "company_id")
        .select("code", "signal", "probability", "model_auc")
        .orderBy(c("probability").desc(), "code")
    )


def trade_intents(predictions: DataFrame, keys=("date",), suffix: str = ".IS") -> DataFrame:
    """L-1, T-3: sells before buys, strongest first, ties by probability.

    A day has at most one prediction per company.
    """
    side = F.when(c("signal") > 0, -c("signal")).otherwise(c("signal"))
    w = Window.partitionBy(*keys).orderBy(c("signal") > 0, side, c("probability").desc(), "code")
    return (
        predictions.filter(c("signal") != 0)
        .withColumns({"seq": F.row_number().over(w), "action": action(c("signal"))})
        .withColumn("symbol", ticker(c("code"), suffix))
    )


def signal_counts(predictions: DataFrame, by=("date",)) -> DataFrame:
    """A-16."""
    return predictions.groupBy(*by).agg(
        F.count_if(c("signal") > 0).alias("buys"),
        F.count_if(c("signal") < 0).alias("sells"),
        F.count_if(c("signal") == 0).alias("holds"),
    )


def latest_price(bars: DataFrame, as_of: dt.date, days: int = PRICE_DAYS) -> DataFrame:
    """L-7: last close of the ``days`` up to ``as_of``; absent if there is none."""
    recent = bars.filter(
        (c("date") >= F.lit(as_of - dt.timedelta(days=days))) & (c("date") <= F.lit(as_of)) & c("close").isNotNull()
    )
    return recent.groupBy("symbol").agg(F.max_by("close", "date").alias("price"))


def units_by_count(money: Column, price: Column, unit=TRADE_UNIT) -> Column:
    """L-2: as many units as the money pays for, at most ``unit``."""
    return F.greatest(F.least(F.lit(unit), F.floor(F.try_divide(money, price))), F.lit(0)).cast("bigint")


def units_by_budget(money: Column, price: Column, budget: float = TRADE_BUDGET) -> Column:
    """L-3: as many units as both the budget and the money pay for."""
    by_budget = F.floor(F.try_divide(F.lit(budget), price))
    return F.greatest(F.least(by_budget, F.floor(F.try_divide(money, price))), F.lit(0)).cast("bigint")


def units_to_sell(held: Column, unit: Column | None = None) -> Column:
    """L-4."""
    return held if unit is None else F.least(unit, held)


def valuation(cash: DataFrame, held: DataFrame, prices: DataFrame) -> DataFrame:
    """A-15: cash, value of the priced positions, and their sum."""
    worth = (
        held.join(prices, "symbol", "left")
        .groupBy("wallet")
        .agg(F.coalesce(F.sum(c("units") * c("price")), F.lit(0.0)).alias("portfolio_value"))
    )
    return (
        cash.join(worth, "wallet", "left")
        .fillna({"portfolio_value": 0.0})
        .withColumn("total", c("money") + c("portfolio_value"))
    )
