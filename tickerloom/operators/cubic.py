"""A support vector machine over all products of up to three columns, without writing the products down.

With a 1 beside the d columns, the sum over all products is a sum over pairs of columns times a linear form, so a pass
costs two products of matrices on the rows' few columns; (d + 1)(d + 2)(d + 3) / 6 terms a row are neither stored nor read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.operators import logistic
from tickerloom.operators.stacks import matrix

#: Rows whose products are formed at once.
BLOCK = 512
#: Steps that the curvature is estimated from, and steps that a search along a direction may take.
MEMORY, TRIES = 10, 20


def _third(width: int) -> np.ndarray:
    """For each pair (i <= j) of the columns with a 1 in front, which third columns (k >= j) it has a product with."""
    return np.arange(width + 1) >= np.triu_indices(width + 1)[1][:, None]


def _blocks(x: np.ndarray, center: np.ndarray, scale: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """A 1 and the scaled columns, and the products of their pairs, each as a row; some rows of the table at a time."""
    width = len(center) + 1
    held = np.empty((width * (width + 1) // 2, BLOCK))
    for at in range(0, len(x), BLOCK):
        part = slice(at, min(at + BLOCK, len(x)))
        z = np.ones((width, part.stop - at))
        z[1:] = ((x[part] - center) / scale).T
        pairs, to = held[:, : part.stop - at], 0
        for i in range(width):
            np.multiply(z[i:], z[i], out=pairs[to : to + width - i])
            to += width - i
        yield part, z, pairs


def _margin(z: np.ndarray, pairs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (weights.T @ pairs * z).sum(axis=0)


def _total(rows: DataFrame, width: int, of_block: Callable, size: int) -> np.ndarray:
    """The sum over all rows of what ``of_block`` gives for (y, scaled columns, their pairs) of some rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            out += of_block(batch.column("y").to_numpy(), matrix(batch.column("x"), width))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    return np.zeros(size) + logistic.added_up(rows.mapInArrow(sums, "sums binary"))


@dataclass
class CubicModel:
    columns: list[str]
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the margin as ``rawPrediction``."""
        names, center, scale, weights = self.columns, self.center, self.scale, self.weights

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
                out = np.zeros(len(x))
                for part, z, pairs in _blocks(x, center, scale):
                    out[part] = _margin(z, pairs, weights)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "rawPrediction"])

        return df.mapInArrow(scored, T.StructType([*df.schema, T.StructField("rawPrediction", T.DoubleType())]))


@dataclass
class CubicSVM:
    """Least mean hinge loss over standardized columns; each product is scaled by its deviation, constant ones are left out.

    Quasi-Newton steps of limited memory; a pass over the rows gives the loss and its slope.
    """

    columns: list[str]
    label: str = "target"
    iterations: int = 100
    tolerance: float = 1e-6

    def fit(self, df: DataFrame) -> CubicModel:
        width = len(self.columns)
        rows = df.select(F.col(self.label).cast("double").alias("y"), F.array(*self.columns).alias("x"))
        center, scale = logistic.scales(rows, width)
        third = _third(width)
        shape, size = third.shape, third.size

        def moments(y: np.ndarray, x: np.ndarray) -> np.ndarray:
            out = np.zeros((2, *shape))
            for _, z, pairs in _blocks(x, center, scale):
                out += pairs @ z.T, pairs**2 @ (z**2).T
            return np.append(out.ravel(), len(y))

        *both, n = _total(rows, width, moments, 2 * size + 1)
        first, second = np.array(both).reshape(2, *shape) / max(n, 1)
        variance = (second - first**2) * n / max(n - 1, 1)
        used = third & (variance > 1e-12 * second)
        unit = np.where(used, 1 / np.sqrt(np.where(used, variance, 1.0)), 0.0)
        unit[0, 0] = 1.0  # the intercept
        scaled = unit.ravel()

        def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
            weights = (at * scaled).reshape(shape)

            def hinge(y: np.ndarray, x: np.ndarray) -> np.ndarray:
                total, slope = 0.0, np.zeros(shape)
                side = 2 * y - 1
                for part, z, pairs in _blocks(x, center, scale):
                    short = 1 - side[part] * _margin(z, pairs, weights)
                    hit = short > 0
                    total += short[hit].sum()
                    slope -= pairs @ (z * (side[part] * hit)).T
                return np.append(slope.ravel(), total)

            *slope, total = _total(rows, width, hinge, size + 1) / max(n, 1)
            return total, np.array(slope) * scaled

        best = _least(loss, np.zeros(size), self.iterations, self.tolerance)
        return CubicModel(self.columns, center, scale, (best * scaled).reshape(shape))


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    return float((a * b).sum())  # without the threads of a linear algebra library, see functions.linear


def _least(loss: Callable, x: np.ndarray, iterations: int, tolerance: float) -> np.ndarray:
    """The point that limited-memory quasi-Newton steps reach on a convex loss, which may have kinks."""
    value, slope = loss(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(iterations):
        way, shares = -slope, []
        for step, turn, weight in reversed(moves):
            shares.append(weight * _dot(step, way))
            way = way - shares[-1] * turn
        if moves:
            step, turn, weight = moves[-1]
            way = way / (weight * _dot(turn, turn))
        for (step, turn, weight), share in zip(moves, reversed(shares)):
            way = way + (share - weight * _dot(turn, way)) * step
        fall = _dot(slope, way)
        if not fall < 0:
            break
        # A step long enough to turn the slope and short enough to lower the loss, by halving.
        low, high, length, found = 0.0, np.inf, 1.0 if moves else 0.5 / np.sqrt(_dot(slope, slope)), None
        for _ in range(TRIES):
            new_value, new_slope = loss(x + length * way)
            if new_value > value + 1e-4 * length * fall:
                high = length
            else:
                found = length, new_value, new_slope
                if _dot(new_slope, way) >= 0.9 * fall:
                    break
                low = length
            length = 2 * low if high == np.inf else (low + high) / 2
        if found is None:
            break
        length, new_value, new_slope = found
        step, turn = length * way, new_slope - slope
        if _dot(step, turn) > 1e-12 * _dot(turn, turn):
            moves = [*moves[-MEMORY + 1 :], (step, turn, 1 / _dot(step, turn))]
        gain = value - new_value
        x, value, slope = x + step, new_value, new_slope
        if gain <= tolerance * 1e-3 * max(value, 1e-12):
            break
    return x
