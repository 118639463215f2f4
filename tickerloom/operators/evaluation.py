"""Scaling, splits and scores of predictions, as aggregates and windows."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.numeric import div
from tickerloom.operators.ranks import bucket
from tickerloom.operators.stacks import Cells, Stack

c = F.col


def q(name: str):
    return c(f"`{name}`")


def standardize(df: DataFrame, columns: list[str], by: str = "symbol") -> DataFrame:
    """M-1: zero mean and unit population deviation per group; constants become 0."""
    w = Window.partitionBy(by)

    def scaled(x: Column) -> Column:
        sd = F.stddev_pop(x).over(w)
        return (x - F.avg(x).over(w)) / F.when(sd == 0, 1.0).otherwise(sd)

    return df.withColumns({n: scaled(q(n)) for n in columns})


def stratified_split(
    df: DataFrame, key: list[str], label: str = "target", by: str = "symbol", share: float = 0.1, seed: str = "42"
) -> DataFrame:
    """M-2: marks ``share`` of each (group, label) as validation, in hash order.

    A group is ranked in one task: use it for groups that the calendar bounds.
    """
    if isinstance(df, Stack):
        parts = [df.strings(k) for k in key]
        names = ["|".join([x for x in row if x is not None] + [seed]) for row in zip(*parts)]
        digest = np.array([hashlib.md5(x.encode()).digest() for x in names], object)
        rank = np.argsort(np.argsort(digest, kind="stable"), kind="stable")
        number, n = df.row_number_by(df.column(label), [rank])
        return df.withColumn("is_valid", number <= rounded_share(n, share))
    order = F.md5(F.concat_ws("|", *[q(k).cast("string") for k in key], F.lit(seed)))
    w = Window.partitionBy(by, label).orderBy(order, *key)
    n = F.count(F.lit(1)).over(Window.partitionBy(by, label))
    return df.withColumn("is_valid", F.row_number().over(w) <= F.round(n * share))


def rounded_share(n: Cells, share: float) -> Cells:
    return Cells(n.stack, np.floor(n.v * share + 0.5), n.ok)


def time_split(df: DataFrame, share: float = 0.1, by: str = "symbol") -> DataFrame:
    """M-2: the last ``share`` of each symbol's rows is validation."""
    if isinstance(df, Stack):
        return df.withColumn("is_valid", df.row_number_from_end() <= rounded_share(df.rows_of_symbol(), share))
    w = Window.partitionBy(by).orderBy(c("date").desc())
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    return df.withColumn("is_valid", F.row_number().over(w) <= F.round(n * share))


def class_weight(df: DataFrame, label: str = "target", by: str = "symbol") -> DataFrame:
    """A-18."""
    neg, pos = F.count_if(c(label) == 0), F.count_if(c(label) == 1)
    return df.groupBy(by).agg((neg / F.greatest(pos, F.lit(1))).alias("pos_weight"))


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None, wide: bool = False) -> DataFrame:
    """M-8: exact area under the curve; 0.5 where a class is missing.

    A group is ordered once and summed in that order: with a running count that includes equal scores, the negatives up
    to each positive and the positives up to each negative give the pairs won and the pairs tied. Without groups, and in
    ``wide`` groups, which the calendar does not bound, scores are first reduced to one row per distinct value, so a
    frequent value is no large partition, and ordered in score ranges; only the sums of the ranges are put in order.
    """
    by = by or []
    df = df.select(*[q(b) for b in by], q(score).alias("_s"), *[F.when(q(label) == k, 1).otherwise(0).cast("bigint").alias(n) for k, n in ((1, "_p"), (0, "_n"))])
    keys = by
    if wide or not by:
        at = df.groupBy(*by, "_s").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
        df, keys = at.withColumn("_bucket", bucket(c("_s"))).filter(c("_bucket").isNotNull()), [*by, "_bucket"]
    upto = Window.partitionBy(*keys).orderBy("_s")  # with all rows of an equal score
    sums = (
        df.withColumns({"_n_upto": F.sum("_n").over(upto), "_p_upto": F.sum("_p").over(upto)})
        .groupBy(*keys)
        .agg(
            F.sum("_p").alias("n_pos"),
            F.sum("_n").alias("n_neg"),
            (F.sum(c("_p") * c("_n_upto")) - F.sum(c("_n") * c("_p_upto"))).alias("_ahead"),
        )
        .withColumn("_wins", (c("_ahead") + c("n_pos") * c("n_neg")) / 2)
    )
    if keys != by:
        before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_wins", c("_wins") + c("n_pos") * F.coalesce(F.sum("n_neg").over(before), F.lit(0)))
        sums = sums.groupBy(*by).agg(*[F.sum(n).alias(n) for n in ("_wins", "n_pos", "n_neg")])
    area = F.coalesce(div(c("_wins"), (c("n_pos") * c("n_neg")).cast("double")), F.lit(0.5))
    return sums.select(*[q(b) for b in by], "n_pos", "n_neg", area.alias("auc"))


def confusion(df: DataFrame, label: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """M-9: rows per (label, prediction)."""
    return df.groupBy(*(by or []), q(label).alias("label"), q(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("count")
    )


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """M-9: precision, recall, F1 and support per class."""
    cells = confusion(df, label, pred)
    hits = cells.filter(c("label") == c("pred")).groupBy("label").agg(F.sum("count").alias("_hit"))
    real = cells.groupBy("label").agg(F.sum("count").alias("support"))
    said = cells.groupBy(c("pred").alias("label")).agg(F.sum("count").alias("_said"))
    out = real.join(said, "label", "full_outer").join(hits, "label", "left").fillna(0)
    p = F.coalesce(div(c("_hit").cast("double"), c("_said").cast("double")), F.lit(0.0))
    r = F.coalesce(div(c("_hit").cast("double"), c("support").cast("double")), F.lit(0.0))
    out = out.withColumns({"precision": p, "recall": r})
    f1 = F.coalesce(div(2 * c("precision") * c("recall"), c("precision") + c("recall")), F.lit(0.0))
    return out.withColumn("f1", f1).select("label", "precision", "recall", "f1", "support")


def weighted_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """M-9: accuracy and support-weighted precision, recall and F1."""
    report = class_report(df, label, pred)
    n = F.sum("support")
    weighted = report.agg(
        *[div(F.sum(c(m) * c("support")), n.cast("double")).alias(m) for m in ("precision", "recall", "f1")]
    )
    # The weighted recall is the accuracy.
    return weighted.select(c("recall").alias("accuracy"), "precision", "recall", "f1")


def leaderboard(results: DataFrame) -> DataFrame:
    """T-4."""
    return results.orderBy(c("val_auc").desc_nulls_last(), "combination")
