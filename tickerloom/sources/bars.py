"""Daily bars: read, clean, build from ticks, select ranges, resample."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom import schemas
from tickerloom.functions.numeric import finite
from tickerloom.operators.stacks import Stack

PRICES = ["open", "high", "low", "close"]


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """S-2: one table of all symbols; NaN and infinities become null."""
    df = spark.read.schema(schemas.BARS).parquet(path)
    return df.withColumns({n: finite(F.col(n)) for n in [*PRICES, "volume"]})


def bars_from_ticks(ticks: DataFrame) -> DataFrame:
    """Daily bars from ticks(symbol, date, seq, open_tick, close_tick, low_tick, high_tick, quantity).

    ``seq`` must order the ticks of a symbol and day without ties. The bars are
    one partial aggregate: a hot symbol is reduced before the shuffle.
    """
    return ticks.groupBy("symbol", "date").agg(
        F.min_by("open_tick", "seq").alias("open"),
        F.max("high_tick").alias("high"),
        F.min("low_tick").alias("low"),
        F.max_by("close_tick", "seq").alias("close"),
        F.sum("quantity").alias("volume"),
    )


def with_min_history(bars: DataFrame, min_rows: int = 300) -> DataFrame:
    """P-5: keep symbols with at least ``min_rows`` bars."""
    if isinstance(bars, Stack):
        return bars.filter(bars.rows_of_symbol() >= min_rows)
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return bars.withColumn("_n", n).filter(F.col("_n") >= min_rows).drop("_n")


def recent_history(bars: DataFrame, as_of: dt.date, days: int = 2000) -> DataFrame:
    """Bars of the last ``days`` calendar days up to ``as_of``."""
    return bars.filter(
        (F.col("date") > F.lit(as_of - dt.timedelta(days=days))) & (F.col("date") <= F.lit(as_of))
    )


def bars_in_range_of(bars: DataFrame, other: DataFrame, date: str = "date") -> DataFrame:
    """S-3: bars between the first and last date of another table."""
    first, last = other.agg(F.min(date)), other.agg(F.max(date))
    return bars.filter(F.col("date").between(first.scalar(), last.scalar()))


def local_date(ts, tz: str = "Europe/Istanbul"):
    """F-26: calendar date of a UTC timestamp in the exchange's time zone."""
    return F.to_date(F.from_utc_timestamp(ts, tz))


def period_end(date, freq: str):
    """Label of the week (Sunday), month or quarter that holds a date."""
    if freq == "W":
        return F.date_add(F.trunc(date, "week"), 6)
    if freq == "M":
        return F.last_day(date)
    if freq == "Q":
        return F.last_day(F.add_months(F.trunc(date, "quarter"), 2))
    raise ValueError(f"unknown frequency {freq!r}")


def resample_last(df: DataFrame, freq: str, keys=("symbol",), columns=None) -> DataFrame:
    """A-7: last non-null value of each column per period."""
    columns = columns or [n for n in df.columns if n not in (*keys, "date")]
    return df.groupBy(*keys, period_end(F.col("date"), freq).alias("period")).agg(
        *[
            F.max_by(F.col(f"`{n}`"), F.when(F.col(f"`{n}`").isNotNull(), F.col("date"))).alias(n)
            for n in columns
        ]
    )
