"""Row-based window primitives over (symbol, date).

A symbol has at most one row per calendar day, so a window partition is bounded
by the length of the calendar (about 25,000 rows in a century), whatever the
number of ticks behind the bars.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.numeric import div
from tickerloom.operators.stacks import Cells, Stack, tools

KEY, TIME = "symbol", "date"


def by_symbol():
    return Window.partitionBy(KEY).orderBy(TIME)


def trailing(n: int):
    return by_symbol().rowsBetween(-(n - 1), 0)


def so_far():
    return by_symbol().rowsBetween(Window.unboundedPreceding, 0)


def lag(x: Column, k: int = 1) -> Column:
    if isinstance(x, Cells):
        return x.lag(k)
    return F.lag(x, k).over(by_symbol())


def lead(x: Column, k: int = 1) -> Column:
    if isinstance(x, Cells):
        return x.lag(-k)
    return F.lead(x, k).over(by_symbol())


def diff(x: Column, k: int = 1) -> Column:
    return x - lag(x, k)


def pct_change(x: Column, k: int = 1) -> Column:
    """Relative change to k rows before; pass a forward-filled column to pad gaps."""
    return div(x, lag(x, k)) - 1


def rolling(fn, x: Column, n: int) -> Column:
    """fn over the last n rows, null until the window holds n non-null values."""
    if isinstance(x, Cells):
        return x.rolling(fn.__name__, n)
    w = trailing(n)
    return F.when(F.count(x).over(w) == n, fn(x).over(w))


def roll_mean(x: Column, n: int) -> Column:
    return rolling(F.avg, x, n)


def roll_sum(x: Column, n: int) -> Column:
    return rolling(F.sum, x, n)


def roll_std(x: Column, n: int) -> Column:
    return rolling(F.stddev_samp, x, n)


def roll_min(x: Column, n: int) -> Column:
    return rolling(F.min, x, n)


def roll_max(x: Column, n: int) -> Column:
    return rolling(F.max, x, n)


def add_long_extremes(df: DataFrame, specs: Mapping[str, tuple], span: int, size: int) -> DataFrame:
    """Add the least or greatest value of the last ``span`` rows from those of ``size`` rows: name to (fn, column).

    A sliding frame reads its rows anew for every row; this reads span / size of the finished values. Null until the
    window holds ``span`` non-null values.
    """
    starts, keep = range(size, span, size), df.columns
    F, _ = tools(df)
    _c = partial(_column, df)
    if span % size:
        raise ValueError("span must be a multiple of size")
    df = df.withColumns({f"_at{k}_{name}": lag(_c(x), k) for name, (_, x) in specs.items() for k in starts})
    final = {}
    for name, (fn, x) in specs.items():
        parts = [_c(x), *[_c(f"_at{k}_{name}") for k in starts]]
        # The windows lie side by side, so the one farthest back is there only after span rows.
        final[name] = F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in reversed(parts)]), fn(*parts))
    return df.withColumns(final).select(*[n if isinstance(df, Stack) else _c(n) for n in keep if n not in final], *final)


def cum_sum(x: Column) -> Column:
    if isinstance(x, Cells):
        return x.running()
    return F.sum(x).over(so_far())


def ffill(x: Column) -> Column:
    if isinstance(x, Cells):
        return x.ffill()
    return F.last(x, ignorenulls=True).over(so_far())


def bfill(x: Column) -> Column:
    """A running frame in falling order: a frame that ends at the last row is read anew for every row."""
    if isinstance(x, Cells):
        return x.bfill()
    falling = Window.partitionBy(KEY).orderBy(F.col(TIME).desc())
    return F.last(x, ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, 0))


def last_per_symbol(df: DataFrame) -> DataFrame:
    """Row with the greatest date per symbol, as a partial aggregate (no window)."""
    row = F.struct(TIME, *[c for c in df.columns if c not in (KEY, TIME)])
    return df.groupBy(KEY).agg(F.max_by(row, TIME).alias("r")).select(KEY, "r.*")


def head(df: DataFrame, n: int) -> DataFrame:
    return _ranked(df, F.col(TIME).asc(), n)


def tail(df: DataFrame, n: int) -> DataFrame:
    return _ranked(df, F.col(TIME).desc(), n)


def _ranked(df: DataFrame, order: Column, n: int) -> DataFrame:
    w = Window.partitionBy(KEY).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


# -- recursive smoothing -----------------------------------------------------

@dataclass(frozen=True)
class Ewm:
    """Exponentially weighted mean of a column.

    adjust=False: y = (1-a)*y' + a*x, started at the first value.
    adjust=True: weighted mean with weights (1-a)^age.
    a = 2 / (span + 1). Gaps age the weights and repeat the last mean.
    """

    x: str
    span: int
    adjust: bool = False


# Weights inside a block fall to exp(-DECAY), still a normal double.
DECAY = 600


def with_blocks(df: DataFrame, spans) -> DataFrame:
    """Add row positions and blocks, to share them between several ``add_ewm``."""
    rates = [-math.log(1 - _alpha(n)) for n in spans]
    if max(rates) > 10 * min(rates):
        raise ValueError("spans too far apart for common blocks: smooth them separately")
    rows = int(DECAY / max(rates))
    number = df.row_number() if isinstance(df, Stack) else F.row_number().over(by_symbol())
    df = df.withColumn("_pos", number.cast("double"))
    f, c = tools(df)
    df = df.withColumns({"_blk": f.floor((c("_pos") - 1) / rows), "_age": (c("_pos") - 1) % rows})
    return df.withColumn("_end", _column(df, "_age") == rows - 1)


def add_ewm(df: DataFrame, specs: Mapping[str, Ewm]) -> DataFrame:
    """Add several exponentially weighted means in one pass, without Python.

    With d = 1-a, the weighted sums are d^p * sum(u / d^p) over the rows p of a
    block. A block is as long as d^p allows (thousands of rows), so what came
    before the last block has faded below the precision of a double: one carry,
    the end value of the last block, is enough. All windows need the same order,
    and only the symbol is shuffled on.
    """
    if any(s.span <= 1 for s in specs.values()):
        raise ValueError("span must be greater than 1")
    shared = "_blk" in df.columns
    out = df if shared else with_blocks(df, [s.span for s in specs.values()])
    F, col = tools(out)
    if isinstance(df, Stack):
        first_rows = np.flatnonzero(col("_age").v == 0)
        greatest_before = last_before = lambda x: x.before()
        in_block = lambda x: x.running(first_rows)
    else:
        order = Window.partitionBy(KEY).orderBy("_blk", TIME)
        earlier = order.rowsBetween(Window.unboundedPreceding, -1)
        inside = Window.partitionBy(KEY, "_blk").orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
        greatest_before = lambda x: F.max(x).over(earlier)
        last_before = lambda x: F.last(x, ignorenulls=True).over(earlier)
        in_block = lambda x: F.sum(x).over(inside)

    def c(name: str) -> Column:
        return _column(out, name)

    xs = sorted({s.x for s in specs.values()})
    prev = {x: f"_prev{i}" for i, x in enumerate(xs)}
    out = out.withColumns({prev[x]: greatest_before(F.when(c(x).isNotNull(), c("_pos"))) for x in xs})
    # Per mean: the value each row adds, and its weight relative to the block start.
    # Gaps change the weight by a factor, whose logarithm is 0 without gaps.
    terms = {}
    for i, s in enumerate(specs.values()):
        x, before = c(s.x), c(prev[s.x])
        alpha, keep = _alpha(s.span), 1 - _alpha(s.span)
        if s.adjust:
            terms[f"_u{i}"] = F.coalesce(x, F.lit(0.0))
            continue
        gap = c("_pos") - before
        total = F.when(gap == 1, 1.0).otherwise(F.pow(F.lit(keep), gap) + alpha)
        moved = x.isNotNull() & before.isNotNull()
        terms[f"_u{i}"] = F.when(moved, alpha * x / total).otherwise(F.coalesce(x, F.lit(0.0)))
        # Rows without a value do not age the mean until the next value arrives.
        held = F.when(x.isNotNull(), 0.0).otherwise(-math.log(keep))
        catch_up = F.when(moved & (gap > 1), math.log(keep) * (gap - 1) - F.log(total)).otherwise(0.0)
        terms[f"_g{i}"] = held + catch_up
    out = out.withColumns(terms)

    weights, sums, carries, final = {}, {}, {}, {}
    for i, s in enumerate(specs.values()):
        weight = F.pow(F.lit(1 - _alpha(s.span)), c("_age"))
        weights[f"_w{i}"] = weight if s.adjust else weight * F.exp(in_block(c(f"_g{i}")))
    out = out.withColumns(weights)
    for i, s in enumerate(specs.values()):
        w = c(f"_w{i}")
        sums[f"_n{i}"] = w * in_block(c(f"_u{i}") / w)
        if s.adjust:
            seen = F.when(c(s.x).isNotNull(), 1.0).otherwise(0.0)
            sums[f"_d{i}"] = w * in_block(seen / w)
    out = out.withColumns(sums)
    for name in sums:
        at_end = last_before(F.when(c("_end"), c(name)))
        carries[f"{name}c"] = F.coalesce(at_end, F.lit(0.0))
    out = out.withColumns(carries)
    for i, (name, s) in enumerate(specs.items()):
        # The carry has aged by one step more than the first row of the block.
        step = c(f"_w{i}") * (1 - _alpha(s.span))
        value = c(f"_n{i}") + step * c(f"_n{i}c")
        if s.adjust:
            value = div(value, c(f"_d{i}") + step * c(f"_d{i}c"))
        started = c(s.x).isNotNull() | c(prev[s.x]).isNotNull()
        final[name] = F.when(started, value)
    scratch = [*prev.values(), *terms, *weights, *sums, *carries]
    out = out.withColumns(final).drop(*scratch)
    return out if shared else drop_blocks(out)


def drop_blocks(df: DataFrame) -> DataFrame:
    return df.drop("_pos", "_blk", "_age", "_end")


def _column(df, name: str) -> Column:
    return tools(df)[1](f"`{name}`")


def _alpha(span: int) -> float:
    return 2 / (span + 1)
