"""Numbers and running totals over a whole table, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


# Buckets of one power of two: numbers that differ by less than this share may meet in one.
PARTS = 1 << 16


def bucket(x: Column, parts: int = PARTS) -> Column:
    """An order-preserving bucket of a number, from its power of two and a linear scale between two powers.

    A column expression, so that a plan with it starts no job and a repeated task cuts alike.
    """
    size = F.abs(x.cast("double"))
    power = F.floor(F.log2(size))
    place = F.floor((power + 1100) * parts + (size / F.pow(F.lit(2.0), power) - 1) * parts)
    return F.when(size == 0, F.lit(0)).otherwise(F.signum(x.cast("double")).cast("bigint") * place)


def running_before(df: DataFrame, order: str | list[str], value: str, by: list[str] | None = None) -> DataFrame:
    """Add ``_below``: sum of ``value`` over the rows before, in a unique order that begins with a number.

    Sums run inside each bucket (of each group ``by``) and are shifted by the
    totals of the buckets before, one row per bucket.
    """
    order, by = [order] if isinstance(order, str) else order, by or []
    cut = df.withColumn("_bucket", bucket(c(order[0])))
    keys = [*by, "_bucket"]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    offsets = totals.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    summed = cut.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        summed.join(offsets, keys)
        .withColumn("_below", c("_in") + c("_off"))
        .drop("_bucket", "_in", "_off")
    )


def number_rows(df: DataFrame, name: str, order: str | list[str] = "seq", start: int | Column = 0) -> DataFrame:
    """Consecutive numbers after ``start``, in a unique order that begins with a number."""
    ones = running_before(df.withColumn("_one", F.lit(1).cast("bigint")), order, "_one")
    return ones.withColumn(name, (c("_below") + 1 + start).cast("bigint")).drop("_one", "_below")


#: Buckets of one power of two in which values are counted before those at the quantiles are ordered.
COARSE = 1 << 10


def quantiles(values: DataFrame, by: str, shares: list[float]) -> DataFrame:
    """The exact quantiles q0, q1, ... of each group (linear between neighbours), from rows (by, _x) without nulls.

    All values are only counted by bucket; those of the buckets that hold a quantile's neighbours, two for each of a
    group's quantiles at most, are counted by value and ordered.
    """
    parts = values.withColumn("_part", bucket(c("_x"), COARSE))
    counts = parts.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"_end": F.sum("_n").over(upto), "_total": F.sum("_n").over(Window.partitionBy(by))})
    places = [(c("_total") - 1) * share for share in shares]
    held = F.lit(False)
    for place in places:
        for rank in (F.floor(place), F.ceil(place)):
            held = held | ((rank >= c("_end") - c("_n")) & (rank < c("_end")))
    some = counts.filter(held).select(by, "_part", (c("_end") - c("_n")).alias("_start"), "_total")
    near = parts.join(F.broadcast(some), [by, "_part"]).groupBy(by, "_part", "_start", "_total", "_x").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_before(near, "_x", "_n", [by, "_part"]).withColumn("_below", c("_below") + c("_start"))

    def at(position):
        return F.max(F.when(c("_below") <= position, c("_x")))

    ends = []
    for i, share in enumerate(shares):
        place = (c("_total") - 1) * share
        ends += [
            at(F.floor(place)).alias(f"_lo{i}"),
            at(F.ceil(place)).alias(f"_hi{i}"),
            F.max(place - F.floor(place)).alias(f"_w{i}"),
        ]
    row = ranked.groupBy(by).agg(*ends)
    return row.select(
        by, *[(c(f"_lo{i}") + (c(f"_hi{i}") - c(f"_lo{i}")) * c(f"_w{i}")).alias(f"q{i}") for i in range(len(shares))]
    )
