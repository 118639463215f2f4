"""Null-safe arithmetic shared by all feature operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerloom.operators.stacks import Cells, Functions, tools

# Fixed value: added to denominators of the extended indicators.
EPS = 1e-10


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return (Functions if isinstance(a, Cells) or isinstance(b, Cells) else F).try_divide(a, b)


def finite(c: Column) -> Column:
    """NaN and both infinities become null."""
    if isinstance(c, Cells):
        x = c.cast("double")
        return Cells(x.stack, x.v, x.ok & np.isfinite(x.v))
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def drop_incomplete(df, columns=None):
    """P-3: drop rows with a null, NaN or infinity in any of the columns.

    One filter: NaN sorts above infinity, so both fail the comparison. (Replacing
    the values first would triple every expression in the plan.)
    """
    names = set(columns or df.columns)
    F, c = tools(df)
    keep = F.lit(True)
    for name, kind in df.dtypes:
        if name in names:
            x = c(f"`{name}`")
            number = kind in ("double", "float")
            keep = keep & ((F.abs(x) < F.lit(float("inf"))) if number else x.isNotNull())
    return df.filter(keep)


def zero_fill(df, columns):
    """P-4: null, NaN and infinities become 0 in model inputs."""
    return df.withColumns(
        {n: F.coalesce(finite(F.col(f"`{n}`")), F.lit(0.0)) for n in columns}
    )
