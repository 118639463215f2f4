"""Operators on stacks of symbols against the same operators on DataFrames."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import models, stacks
from tickerloom.operators import timeseries as ts
from tickerloom.operators.macro import FX_COLUMNS
from tickerloom.operators.stacks import over_symbols, tools
from tickerloom.operators.timeseries import Ewm
from tickerloom.plans import features

D = dt.date
NUMBERS = ["open", "high", "low", "close", "volume"]


def odd_bars(spark):
    """Symbols of many lengths, also none and a null one, with gaps, NaN, infinities and days that are no trading days."""
    rng = np.random.default_rng(4)
    rows = []
    for symbol, n in (("A", 420), ("B", 300), ("C", 1), (None, 40), ("D", 13), ("E", 3000), ("F", 330)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        high, low = close + rng.uniform(0, 2, n), close - rng.uniform(0, 2, n)
        for i in range(n):
            row = [float(x) for x in (close[i] + rng.uniform(-1, 1), high[i], low[i], close[i], rng.integers(1, 50))]
            if symbol == "B" and rng.random() < 0.03:
                row[rng.integers(5)] = [None, math.nan, math.inf][rng.integers(3)]
            if symbol == "F" and i % 7 < 2:
                row[3] = row[1] = row[2] = 50.0
            rows.append((symbol, D(1990, 1, 1) + dt.timedelta(days=int(i * 1.5)), *row))
    return spark.createDataFrame(rows, "symbol string, date date, " + ", ".join(f"{n} double" for n in NUMBERS)).repartition(5)


def tables(spark):
    rng = np.random.default_rng(5)
    days = [D(1989, 12, 1) + dt.timedelta(days=k) for k in range(0, 5000)]
    wide = [(day, *[float(v) if rng.random() < 0.8 else None for v in rng.uniform(1, 9, 3)]) for day in days if rng.random() < 0.9]
    fx = spark.createDataFrame(wide, "date date, " + ", ".join(f"{n} double" for n in FX_COLUMNS[:3]))
    us = spark.createDataFrame(wide[40::3], "date date, `one rate` double, b double, c double")
    news = [(s, d, float(rng.normal()), int(rng.integers(1, 5))) for s in "AEF" for d in days[:2000:3]]
    return fx, us, spark.createDataFrame(news, "symbol string, date date, avg_sentiment double, news_count bigint")


def same(got, want):
    assert got.schema.simpleString() == want.schema.simpleString()
    a, b = ({(r.symbol, r.date): r for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(b) > 0
    for key, row in b.items():
        for n, x, y in zip(want.columns, a[key], row):
            if isinstance(y, float) and not math.isnan(y) and not math.isinf(y):
                # The rounding of a difference of large values is no difference.
                assert x == pytest.approx(y, rel=1e-9, abs=1e-9), (key, n)
            else:
                assert x == y or (isinstance(x, float) and math.isnan(x) and math.isnan(y)), (key, n)


def by_windows(monkeypatch):
    monkeypatch.setattr(features, "over_symbols", lambda df, work, numbers: work(df))


@pytest.mark.parametrize("rows", [1, 32_768])
def test_features_equal_those_of_windows(spark, monkeypatch, rows):
    monkeypatch.setattr(stacks, "STACK_ROWS", rows)
    bars, (fx, us, daily) = odd_bars(spark).persist(), tables(spark)
    options = [lambda: features.build_features(bars, fx, us, daily, 60), lambda: features.build_features_macro_first(bars, fx, us, daily)]
    if rows == 1:
        options.append(lambda: features.build_features(bars, min_rows=1))
    got = [build().persist() for build in options]
    by_windows(monkeypatch)
    for g, build in zip(got, options):
        same(g, build())
        g.unpersist()
    bars.unpersist()


def test_the_pipelines_read_no_sliding_frames(spark, tmp_path):
    """A frame of n rows is read anew for every row; all indicators took most of the pipelines' time."""
    odd_bars(spark).write.parquet(str(tmp_path / "bars"))
    bars, (fx, us, daily) = spark.read.parquet(str(tmp_path / "bars")), tables(spark)
    for out in (features.build_features(bars, fx, us, daily), features.build_features_macro_first(bars, fx, us, daily)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "specifiedwindowframe(RowFrame, -" not in plan


def test_primitives_with_nulls(spark):
    """Nothing is dropped here, so nulls and NaN are compared as well."""

    def work(df):
        F, c = tools(df)
        x = c("close")
        df = ts.add_ewm(df, {"r": Ewm("close", 9), "n": Ewm("close", 20, adjust=True)})
        return df.withColumns({
            "lag": ts.lag(x, 3), "lead": ts.lead(x), "sum": ts.roll_sum(x, 5), "std": ts.roll_std(x, 4), "low": ts.roll_min(x, 6),
            "high": ts.roll_max(x, 6), "so_far": ts.cum_sum(x), "fill": ts.ffill(x), "back": ts.bfill(x), "change": ts.pct_change(x, 2),
            "up": F.when(x > c("open"), 1).otherwise(0), "most": F.greatest(x, c("low"), c("open")), "least": F.least(x, c("low")),
            "both": F.coalesce((x > c("open")) & (c("volume") > 9), F.lit(False)).cast("int"), "sign": F.signum(x - c("open")),
        })

    df = odd_bars(spark).filter("symbol = 'B' OR symbol = 'C' OR symbol IS NULL").withColumn("text", F.col("symbol"))
    same(over_symbols(df, work, NUMBERS), work(df))


def test_other_types_take_the_windows(spark, make_bars):
    bars = make_bars([float(k) for k in range(40)]).withColumn("volume", F.lit(1).cast("decimal(9,2)"))
    out = over_symbols(bars, lambda df: df.withColumn("x", ts.cum_sum(tools(df)[1]("volume"))), NUMBERS)
    assert out.agg(F.max("x")).first()[0] == 40 and "Decimal" in str(out.schema["x"].dataType)


@pytest.mark.parametrize("split", ["time", "stratified"])
def test_training_needs_no_exchange_of_features(spark, tmp_path, split):
    """Features are wide; models are fitted where they are made, with the rows and split of a stored table."""
    odd_bars(spark).filter("symbol <> 'E'").write.parquet(str(tmp_path / "bars"))
    bars, (fx, us, daily) = spark.read.parquet(str(tmp_path / "bars")), tables(spark)
    table = features.build_features(bars, fx, us, daily, 20)
    columns, day = features.feature_columns(), F.lit(D(2020, 1, 1))
    out = models.train_models(table, columns, day, split)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "SMA_50" not in plan.split("MapInArrow")[1]
    table.write.parquet(str(tmp_path / "features"))
    stored = spark.read.parquet(str(tmp_path / "features"))
    # A column of another type is split by windows.
    other = stored.withColumn("target", F.col("target").cast("smallint"))
    got = [{r.symbol: r for r in models.train_models(df, columns, day, split).collect()} for df in (table, stored, other)]
    assert got[0].keys() == got[1].keys() == got[2].keys() and len(got[0]) > 1
    for symbol, a in got[0].items():
        for b in (got[1][symbol], got[2][symbol]):
            assert (a.rows, a.epochs_trained, a.val_auc, a.train_auc) == (b.rows, b.epochs_trained, pytest.approx(b.val_auc), pytest.approx(b.train_auc))
            assert np.allclose(a.weights, b.weights) and np.allclose(a.center, b.center)
