"""Summaries of a feature table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.numeric import div, finite
from tickerloom.operators.ranks import quantiles

c = F.col


def q(name: str):
    return c(f"`{name}`")


def yearly_mean(bars: DataFrame, columns=("open", "high", "low", "close")) -> DataFrame:
    """A-3."""
    return bars.groupBy("symbol", F.year("date").alias("year")).agg(*[F.avg(n).alias(n) for n in columns])


def mean_by_flag(df: DataFrame, flag: str, columns: list[str]) -> DataFrame:
    """A-4."""
    return df.groupBy(flag).agg(*[F.avg(q(n)).alias(n) for n in columns])


def with_calendar(df: DataFrame) -> DataFrame:
    """D-48."""
    return df.withColumns({"day": F.dayofmonth("date"), "month": F.month("date"), "year": F.year("date")})


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """A-5: one row per column, all columns together. The quartiles are exact.

    The cells become rows of (column, value); only values near a quartile are shuffled and ordered.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("column"), q(n).cast("double").alias("_x")) for n in columns])
    long = df.select(F.inline(cells))
    values = long.filter(c("_x").isNotNull())
    x = {n: q(n).cast("double") for n in columns}
    rows = [
        F.struct(F.lit(n).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                 F.min(v).alias("min"), F.max(v).alias("max"))
        for n, v in x.items()
    ]
    moments = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    return moments.join(quantiles(values, "column", [0.25, 0.5, 0.75]), "column", "left").select(
        "column", "count", "mean", "std", "min", c("q0").alias("p25"), c("q1").alias("p50"), c("q2").alias("p75"), "max"
    )


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """A-6: one row per column."""
    counts = F.array(
        *[F.struct(F.lit(n).alias("column"), F.count_if(q(n).isNull()).alias("nulls")) for n in columns]
    )
    return df.agg(counts.alias("rows")).select(F.inline("rows"))


def shape(df: DataFrame) -> DataFrame:
    """A-6: rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def schema_of(df: DataFrame) -> DataFrame:
    """A-6: name and type of each column."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "pos int, column string, type string")


def frequencies(df: DataFrame, by: str) -> DataFrame:
    """A-8: count and share per value, most frequent first."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("share", c("count") / total).orderBy(c("count").desc(), by)


def _products(n: int):
    """Counts, means and centred products of each pair of columns over one task's rows, for the rows that have both."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, n, n))
        near = np.full(n, np.nan)
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            have = np.isfinite(x)
            if np.isnan(near).any():  # the mean of a column's first values, exact for constants: sums keep their digits
                count, low = have.sum(axis=0), np.where(have, x, np.inf).min(axis=0, initial=np.inf)
                low = np.where(count > 0, low, 0.0)
                means = low + np.where(have, x - low, 0.0).sum(axis=0) / np.maximum(count, 1)
                near = np.where(np.isnan(near) & (count > 0), means, near)
            x = np.where(have, x - np.nan_to_num(near), 0.0)
            have = have.astype(float)
            total += np.stack([have.T @ have, x.T @ have, (x * x).T @ have, x.T @ x])
        i, j = np.triu_indices(n, 1)
        both, own, square, product = total
        rows = np.maximum(both[i, j], 1)
        x, y, near = own[i, j] / rows, own[j, i] / rows, np.nan_to_num(near)
        yield pd.DataFrame(
            {"i": i, "j": j, "n": both[i, j], "x": near[i] + x, "y": near[j] + y, "xx": square[i, j] - own[i, j] * x,
             "yy": square[j, i] - own[j, i] * y, "xy": product[i, j] - own[i, j] * y}
        )

    return products


def correlations(df: DataFrame, columns: list[str], above: float | None = None) -> DataFrame:
    """A-9: correlation of each pair of columns, over the rows where both are present.

    A task multiplies its rows as matrices, so hundreds of columns need no more
    plan than two. It centres them near their own means, and the tasks' means
    put their products together, so the rows are made and read once.
    """
    rows = df.select(*[finite(q(n)).alias(f"c{i}") for i, n in enumerate(columns)])
    parts = rows.mapInPandas(_products(len(columns)), "i int, j int, n double, x double, y double, xx double, yy double, xy double")
    # One entry a task that has rows of the pair.
    tasks = F.collect_list(F.when(c("n") > 0, F.struct("n", "x", "y", "xx", "yy", "xy")))
    t = parts.groupBy("i", "j").agg(tasks.alias("_t"), F.sum("n").alias("_n"))

    def summed(value):
        return F.aggregate("_t", F.lit(0.0), lambda a, v: a + value(v))

    def mean(k):
        first = F.get("_t", F.lit(0))[k]
        return first + div(summed(lambda v: v["n"] * (v[k] - first)), c("_n"))

    def products(own, k, m):
        return summed(lambda v: v[own] + v["n"] * (v[k] - c(f"_{k}")) * (v[m] - c(f"_{m}")))

    t = t.withColumns({"_x": mean("x"), "_y": mean("y")})
    xx, yy, xy = products("xx", "x", "x"), products("yy", "y", "y"), products("xy", "x", "y")
    t = t.select("i", "j", xy.alias("xy"), F.sqrt(F.greatest(xx, F.lit(0.0)) * F.greatest(yy, F.lit(0.0))).alias("spread"))
    names = F.array(*[F.lit(n) for n in columns])
    out = t.select(
        F.get(names, c("i")).alias("a"), F.get(names, c("j")).alias("b"),
        div(c("xy"), c("spread")).alias("corr"),
    )
    return out if above is None else out.filter(c("corr") > above)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """A-13: rows per bin; bin 0 and bins+1 hold what lies outside."""
    b = F.width_bucket(q(column), F.lit(float(low)), F.lit(float(high)), F.lit(bins).cast("bigint"))
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def box_stats(df: DataFrame, by: str, column: str) -> DataFrame:
    """A-13: quartiles and whiskers (1.5 interquartile ranges) of a column per group.

    The exact quartiles of a group are found in one task; a symbol's bars are few.
    """
    x = q(column)
    quart = df.groupBy(by).agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_p"))
    quart = quart.select(by, c("_p")[0].alias("p25"), c("_p")[1].alias("p50"), c("_p")[2].alias("p75"))
    reach = 1.5 * (c("p75") - c("p25"))
    near = df.join(quart, by).withColumn(
        "_in", x.between(c("p25") - reach, c("p75") + reach)
    )
    return near.groupBy(by, "p25", "p50", "p75").agg(
        F.min(F.when(c("_in"), x)).alias("low"),
        F.max(F.when(c("_in"), x)).alias("high"),
        F.count_if(~c("_in")).alias("outliers"),
    )


def date_range(df: DataFrame, date: str = "date") -> DataFrame:
    """A-17."""
    return df.agg(F.min(date).alias("first"), F.max(date).alias("last"))


def ordered_distinct(df: DataFrame, key: str, pos: str) -> DataFrame:
    """A-12: first position of each value."""
    return df.groupBy(key).agg(F.min(pos).alias(pos))


def keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """A-11: last row per key."""
    rest = [n for n in df.columns if n not in keys]
    row = F.struct(*[q(n) for n in rest])
    return df.groupBy(*keys).agg(F.max_by(row, seq).alias("_r")).select(*keys, "_r.*")


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """A-14."""
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("count"))
