"""Logistic models in stacks: many sets of columns over one table, and many symbols in one task.

Both are Newton steps on sums over rows. For pooled models the sums are made where the rows are and added up in a tree;
for models per symbol a task holds the rows of some symbols as a stack of matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions.linear import solved
from tickerloom.operators.stacks import Rows, Stack, fits_stacks, matrix, over_symbols

c = F.col

#: Weight of the squared coefficients in the mean loss of pooled models; it makes the solution unique.
RIDGE = 1e-6
#: Rows whose products are formed at once.
BLOCK = 4096
#: Tasks whose sums the driver adds up itself.
FEW = 64
#: Weights of the squared coefficients that a symbol's model is tried with, and Newton steps for each.
PENALTIES = (300.0, 100.0, 30.0, 10.0, 3.0, 1.0, 0.3, 0.1)
STEPS = 3
#: Rows that a stack of symbols holds, about.
STACK_ROWS = 32_768


# -- one table, many sets of columns ------------------------------------------------------------

def scales(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of every element of ``x``; deviation 1 for constants."""
    x = c("x")
    row = rows.agg(*[F.avg(x[i]).alias(f"m{i}") for i in range(width)], *[F.stddev_samp(x[i]).alias(f"d{i}") for i in range(width)]).first()
    center = np.array([row[f"m{i}"] or 0.0 for i in range(width)])
    scale = np.array([row[f"d{i}"] or 0.0 for i in range(width)])
    return center, np.where(scale > 0, scale, 1.0)


def _sums(sets: dict[int, np.ndarray], betas: dict[int, np.ndarray], center: np.ndarray, scale: np.ndarray):
    """Loss, gradient and curvature of each set's model on one task's rows, packed on end."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {k: np.zeros(1 + len(b) + len(b) ** 2) for k, b in betas.items()}
        for batch in batches:
            whole = (matrix(batch.column("x"), len(center)) - center) / scale
            target = batch.column("y").to_numpy()
            for at in range(0, len(whole), BLOCK):
                z, y = np.column_stack([whole[at : at + BLOCK], np.ones(len(whole[at : at + BLOCK]))]), target[at : at + BLOCK]
                for k, beta in betas.items():
                    mine, d = z[:, np.append(sets[k], len(center))], len(beta)
                    margin = mine @ beta
                    p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                    out[k][0] += (np.logaddexp(0, margin) - y * margin).sum()
                    out[k][1 : 1 + d] += mine.T @ (p - y)
                    out[k][1 + d :] += ((mine * (p * (1 - p))[:, None]).T @ mine).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(list(out.values())).tobytes()], pa.binary())], names=["sums"])

    return sums


def added_up(packed: DataFrame) -> np.ndarray:
    """The sum of the tasks' packed vectors: on the driver if they are few, else in a tree."""
    tasks = packed.rdd
    if tasks.getNumPartitions() <= FEW:
        return np.sum([np.frombuffer(r[0]) for r in packed.collect()], axis=0)
    return tasks.map(lambda r: np.frombuffer(r[0])).treeReduce(np.add)


def fit_sets(rows: DataFrame, sets: list[np.ndarray], center: np.ndarray, scale: np.ndarray, steps: int = 40) -> list[np.ndarray]:
    """Coefficients (and the intercept last) of a logistic model for each set of elements of ``x``, scaled, on rows (x, y).

    Every pass over the rows serves all models that have not settled; a step that does not lower the loss is halved.
    ``rows`` is read once a pass: give a stored table.
    """
    n = rows.count()
    betas = [np.zeros(len(s) + 1) for s in sets]
    if not n:
        return betas
    moves, losses, tries = [np.zeros(len(b)) for b in betas], [np.inf] * len(sets), [b.copy() for b in betas]
    open_ = list(range(len(sets)))
    for _ in range(steps):
        asked = {k: tries[k] for k in open_}
        packed = rows.mapInArrow(_sums(dict(enumerate(sets)), asked, center, scale), "sums binary")
        total = added_up(packed)
        at, still = 0, []
        for k in open_:
            d = len(tries[k])
            part = total[at : at + 1 + d + d * d] / n
            at += 1 + d + d * d
            hold = np.append(np.full(d - 1, RIDGE), 0.0)
            loss = part[0] + (hold * tries[k] ** 2).sum() / 2
            if loss > losses[k] + 1e-12:
                moves[k] = moves[k] / 2
            else:
                betas[k], losses[k] = tries[k], loss
                curve = part[1 + d :].reshape(d, d) + np.diag(hold + 1e-12)
                moves[k] = -solved(curve, part[1 : 1 + d] + hold * tries[k])
            if np.abs(moves[k]).max() > 1e-9:
                tries[k] = betas[k] + moves[k]
                still.append(k)
        open_ = still
        if not open_:
            break
    return betas


def set_scores(rows: DataFrame, kept: list[str], sets: list[np.ndarray], betas: list[np.ndarray], center: np.ndarray, scale: np.ndarray) -> DataFrame:
    """``kept`` columns of every row with ``model`` (a number) and ``score`` for each set."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = (matrix(batch.column("x"), len(center)) - center) / scale
            for k, (own, beta) in enumerate(zip(sets, betas)):
                score = z[:, own] @ beta[:-1] + beta[-1]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n) for n in kept), pa.array(np.full(len(z), k, np.int32)), pa.array(score)], names=[*kept, "model", "score"]
                )

    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in kept)
    return rows.mapInArrow(scores, f"{schema}, model int, score double")


# -- a model for each symbol ----------------------------------------------------------------------

def auc(y: np.ndarray, s: np.ndarray) -> float:
    """Area under the curve; 0.5 where a class is missing."""
    pos, neg = s[y == 1], np.sort(s[y == 0])
    if not len(pos) or not len(neg):
        return 0.5
    wins = np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")
    return float(wins.sum() / (2 * len(pos) * len(neg)))


def fit_stack(x: np.ndarray, y: np.ndarray, train: np.ndarray, valid: np.ndarray, penalties=PENALTIES, patience: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Class-weighted logistic models of a stack: ``x`` (models, rows, columns), labels and masks (models, rows).

    From the strongest penalty to the weakest, some Newton steps each; a model keeps the coefficients (the intercept
    last) with its best AUC on its ``valid`` rows, and is left out after ``patience`` penalties without a better one.
    Returns these and the number of steps of each model.
    """
    s, rows, d = x.shape
    x = np.concatenate([x, np.ones((s, rows, 1))], axis=2)
    negative, positive = ((train & (y == k)).sum(axis=1) for k in (0, 1))
    weight = np.where(train, np.where(y == 1, (negative / np.maximum(positive, 1))[:, None], 1.0), 0.0)
    beta, best = np.zeros((s, d + 1)), np.zeros((s, d + 1))
    score, idle, count = np.full(s, -1.0), np.zeros(s, int), np.zeros(s, int)
    live = np.arange(s)
    for penalty in penalties:
        hold = np.append(np.full(d, penalty), 1e-6)
        for _ in range(STEPS):
            z, own = x[live], beta[live]
            p = 1 / (1 + np.exp(-np.clip(np.matmul(z, own[:, :, None])[:, :, 0], -30, 30)))
            slope = np.matmul((weight[live] * (y[live] - p))[:, None, :], z)[:, 0] - hold * own
            curve = np.matmul((z * (weight[live] * p * (1 - p))[:, :, None]).transpose(0, 2, 1), z)
            beta[live] = own + np.linalg.solve(curve + np.diag(hold), slope[:, :, None])[:, :, 0]
        count[live] += STEPS
        margin = np.matmul(x[live], beta[live][:, :, None])[:, :, 0]
        for i, k in enumerate(live):
            now = auc(y[k, valid[k]], margin[i, valid[k]])
            if now > score[k]:
                best[k], score[k], idle[k] = beta[k], now, 0
            else:
                idle[k] += 1
        live = live[idle[live] < patience]
        if not len(live):
            break
    return best, count


MODEL_ROWS = (
    "symbol string, center array<double>, scale array<double>, weights array<double>, bias double, "
    "train_auc double, val_auc double, epochs_trained int, rows bigint"
)


def _fit_symbols(symbols: list, x: np.ndarray, y: np.ndarray, valid: np.ndarray, bounds: np.ndarray, scale_on_all: bool, trainer) -> pa.RecordBatch:
    """Model rows of symbols whose rows lie between ``bounds``."""
    s, longest = len(symbols), int(np.diff(bounds).max())
    stack, label = np.zeros((s, longest, x.shape[1])), np.zeros((s, longest))
    train, check = np.zeros((s, longest), bool), np.zeros((s, longest), bool)
    centers, spreads = np.zeros((s, x.shape[1])), np.ones((s, x.shape[1]))
    for k, (a, z) in enumerate(zip(bounds[:-1], bounds[1:])):
        mine, flag = x[a:z], valid[a:z]
        base = mine if scale_on_all or flag.all() else mine[~flag]
        centers[k], spread = base.mean(axis=0), base.std(axis=0)
        spreads[k] = np.where(spread == 0, 1.0, spread)
        stack[k, : z - a] = (mine - centers[k]) / spreads[k]
        label[k, : z - a], check[k, : z - a], train[k, : z - a] = y[a:z], flag, ~flag
    betas, counts = trainer(stack, label, train, check)
    margin = np.einsum("srd,sd->sr", stack, betas[:, :-1]) + betas[:, -1:]
    areas = [[auc(label[k, m[k]], margin[k, m[k]]) for k in range(s)] for m in (train, check)]
    columns = [symbols, centers.tolist(), spreads.tolist(), betas[:, :-1].tolist(), betas[:, -1].tolist(), *areas, counts.tolist(), np.diff(bounds).tolist()]
    doubles = pa.list_(pa.float64())
    types = [pa.string(), doubles, doubles, doubles, pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int64()]
    names = ["symbol", "center", "scale", "weights", "bias", "train_auc", "val_auc", "epochs_trained", "rows"]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], names=names)


def fit_symbols(features: DataFrame, rows: Callable, width: int, scale_on_all: bool, trainer=fit_stack) -> DataFrame:
    """MODEL_ROWS from what ``rows`` makes of ``features``: (symbol, date, target, x, is_valid). A symbol's rows are in one
    task, bounded by the calendar; a task fits some ten symbols at a time."""
    schema = [(f.name, f.dataType.simpleString()) for f in T._parse_datatype_string(MODEL_ROWS)]

    def fitted(stack: Stack) -> Rows:
        if not len(stack.sizes):
            return Rows(None, schema)
        y, flag = stack.column("target"), stack.column("is_valid").v
        symbols = stack.column("symbol").v.take(pa.array(stack.starts)).to_pylist()
        label, bounds = np.where(y.ok, y.v.astype(float), np.nan), np.append(stack.starts, len(flag))
        return Rows(_fit_symbols(symbols, matrix(stack.column("x").v, width), label, flag, bounds, scale_on_all, trainer), schema)

    if fits_stacks(features) and features.schema["symbol"].dataType == T.StringType():
        return over_symbols(features, lambda df: fitted(rows(df)), [], STACK_ROWS)
    made = rows(features).withColumn("target", c("target").cast("double")).withColumn("symbol", c("symbol").cast("string"))
    return over_symbols(made, fitted, [], STACK_ROWS)
