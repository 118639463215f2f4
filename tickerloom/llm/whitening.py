"""Whitening of embeddings by an incremental eigendecomposition.

1. Every task keeps spectra of the vectors it has read: their number, their mean, and eigenvalues and eigenvectors of
   their scatter about the mean. A vector is a rank-one update, centred on the mean before it. The new eigenvalues are
   the roots of the secular equation; values that the vector does not touch, and all but one of equal values, are left
   out of it (deflation). A task deals its vectors to several spectra in turn and updates all of them in one step.
2. Spectra are combined by rank-one updates, too: one for each eigenvector of the other and one for the difference of the
   means. Tasks combine ``FAN_IN`` at a time until one is left.
3. Rayleigh-Ritz: the covariance of the vectors' projections on those eigenvectors is summed up over all data. It is
   diagonal but for rounding; rotations that make it so turn the eigenvectors into the final components.

Sums of vectors and deviations are whole numbers and exact. What reaches the driver is one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import shared_folder, stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Spectra that a task updates at once, and spectra that one task combines.
CHAINS = FAN_IN = 16
#: Rounding errors are a few of these.
EPS = np.finfo(float).eps
#: Components with a smaller share of the variance than this are rounding errors.
NOTHING = 1e-13


class Spectra:
    """A stack of spectra: numbers (c), means (c, d), eigenvalues (c, d) and eigenvectors as columns (c, d, d)."""

    def __init__(self, count: np.ndarray, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray):
        self.count, self.mean, self.values, self.vectors = count, mean, values, vectors

    @classmethod
    def empty(cls, c: int, d: int) -> Spectra:
        return cls(np.zeros(c), np.zeros((c, d)), np.zeros((c, d)), np.tile(np.eye(d), (c, 1, 1)))

    def add(self, x: np.ndarray) -> None:
        """One vector to each of the first spectra."""
        k = len(x)
        step, m = x - self.mean[:k], self.count[:k]
        self.values[:k], self.vectors[:k] = rank_one(self.values[:k], self.vectors[:k], step * np.sqrt(m / (m + 1))[:, None])
        self.count[:k] += 1
        self.mean[:k] += step / self.count[:k, None]

    def halved(self) -> Spectra:
        """Half as many spectra, each of two (of an odd number, the last one stays)."""
        half, rest = len(self.count) // 2, slice(2 * (len(self.count) // 2), None)
        a, b = slice(0, half), slice(half, 2 * half)
        values, vectors, both = self.values[a], self.vectors[a], self.count[a] + self.count[b]
        for j in range(values.shape[1]):
            values, vectors = rank_one(values, vectors, self.vectors[b, :, j] * np.sqrt(np.maximum(self.values[b, j], 0))[:, None])
        step, some = self.mean[b] - self.mean[a], np.maximum(both, 1)
        values, vectors = rank_one(values, vectors, step * np.sqrt(self.count[a] * self.count[b] / some)[:, None])
        mean = self.mean[a] + step * (self.count[b] / some)[:, None]
        mine = (both, mean, values, vectors)
        last = (self.count[rest], self.mean[rest], self.values[rest], self.vectors[rest])
        return Spectra(*(np.concatenate(x) for x in zip(mine, last)))

    def one(self) -> Spectra:
        now = self
        while len(now.count) > 1:
            now = now.halved()
        return now

    def packed(self) -> bytes:
        return b"".join(np.ascontiguousarray(x, "<f8").tobytes() for x in (self.count, self.mean, self.values, self.vectors))

    @classmethod
    def unpacked(cls, blobs: list[bytes], d: int) -> Spectra:
        flat = np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)
        return cls(*(x.copy() for x in (flat[:, 0], flat[:, 1 : d + 1], flat[:, d + 1 : 2 * d + 1], flat[:, 2 * d + 1 :].reshape(-1, d, d))))


def _rotate_equal(values: np.ndarray, vectors: np.ndarray, z: np.ndarray, tiny: float) -> None:
    """In one spectrum, of nearly equal eigenvalues (in order) all but one lose their part in ``z``."""
    before = -1
    for j in np.flatnonzero(np.abs(z) > 0):
        if before >= 0:
            length = np.hypot(z[before], z[j])
            c, s = z[j] / length, z[before] / length
            gap = values[j] - values[before]
            if abs(gap * c * s) <= tiny:
                z[j], z[before] = length, 0.0
                vectors[:, [before, j]] = np.column_stack([c * vectors[:, before] - s * vectors[:, j], s * vectors[:, before] + c * vectors[:, j]])
                values[before], values[j] = values[before] + gap * s * s, values[j] - gap * s * s
        before = j


def _roots(poles: np.ndarray, weights: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of the secular equation 1 + sum(weights / (poles - x)) of each row, which has ``used`` poles, ascending and
    apart: the nearer pole of each root (its index), and the root's distance from it.

    Each root lies between two poles. Steps follow a fraction with those two poles that touches the function; where a
    step would leave the interval that is known to hold the root, it is halved instead.
    """
    c, d = poles.shape
    j = np.arange(d)
    real = j < used[:, None]
    last = j == used[:, None] - 1
    total = weights.sum(axis=1, keepdims=True)
    gap = np.where(last, total, np.append(poles[:, 1:], poles[:, -1:], axis=1) - poles)
    gap = np.where(real, gap, 1.0)

    def apart(origin: np.ndarray) -> np.ndarray:
        return poles[:, :, None] - np.take_along_axis(poles, origin, 1)[:, None, :]

    def value(away: np.ndarray, t: np.ndarray):
        left = away - t[:, None, :]
        left[left == 0] = 1e-300
        part = weights[:, :, None] / left
        return part, left

    lower = np.tril(np.ones((d, d), bool)).T  # poles up to the root's own
    home = np.tile(j, (c, 1))
    part, _ = value(apart(home), gap / 2)
    right = (1 + part.sum(axis=1) < 0) & ~last & real
    home = home + right
    away = apart(home)
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, np.where(last, gap, gap / 2))
    t = (low + high) / 2
    here, there = np.where(right, -gap, 0.0), np.where(right, 0.0, gap)  # the two poles, from the nearer one
    done = ~real
    for _ in range(80):
        part, left = value(away, t)
        f = 1 + part.sum(axis=1)
        size = 1 + np.abs(part).sum(axis=1)
        done = done | (np.abs(f) <= 2 * EPS * size)
        low, high = np.where(~done & (f < 0), t, low), np.where(~done & (f > 0), t, high)
        done |= high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))
        if done.all():
            break
        slope = part / left
        own = np.where(lower, slope, 0.0).sum(axis=1)
        all_ = slope.sum(axis=1)
        d1, d2 = here - t, there - t
        a = (d1 + d2) * f - d1 * d2 * all_
        b = d1 * d2 * f
        q = f - d1 * own - d2 * (all_ - own)
        root = np.sqrt(np.maximum(a * a - 4 * b * q, 0))
        with np.errstate(all="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * q), 2 * b / (a + root))
            step = np.where(np.isfinite(step) & (step * f < 0), step, -f / all_)
        new = t + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        t = np.where(done, t, new)
    return home, t


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of each matrix of a stack after the outer product of ``v`` is added to it."""
    c, d = values.shape
    z = np.matmul(v[:, None, :], vectors)[:, 0]
    size = np.maximum(np.abs(values).max(axis=1), (z * z).sum(axis=1))
    tiny = 8 * EPS * size
    length = np.sqrt((z * z).sum(axis=1))
    z = np.where(np.abs(z) * length[:, None] <= tiny[:, None], 0.0, z)
    order = np.lexsort((values, z == 0))  # untouched values last
    values, z = np.take_along_axis(values, order, 1), np.take_along_axis(z, order, 1)
    vectors = np.take_along_axis(vectors, order[:, None, :], 2)
    sizes = np.hypot(z[:, 1:], z[:, :-1])
    with np.errstate(all="ignore"):
        close = (z[:, 1:] != 0) & (np.abs((values[:, 1:] - values[:, :-1]) * z[:, 1:] * z[:, :-1] / (sizes * sizes)) <= tiny[:, None])
    again = np.flatnonzero(close.any(axis=1))
    for k in again:
        _rotate_equal(values[k], vectors[k], z[k], tiny[k])
    if len(again):
        order = np.lexsort((values, z == 0))
        values, z = np.take_along_axis(values, order, 1), np.take_along_axis(z, order, 1)
        vectors = np.take_along_axis(vectors, order[:, None, :], 2)
    used = (z != 0).sum(axis=1)
    if not used.any():
        return values, vectors
    j = np.arange(d)
    real = j < used[:, None]
    # Places after the last touched value get poles that are far from all others.
    poles = np.where(real, values, values.max(axis=1, keepdims=True) + size[:, None] * (2.0 + j) + 1.0)
    home, t = _roots(poles, z * z, used)
    new = np.where(real, np.take_along_axis(poles, home, 1) + t, values)
    # From pole i (rows) to root j (columns), without cancellation.
    away = poles[:, :, None] - np.take_along_axis(poles, home, 1)[:, None, :] - t[:, None, :]
    both = real[:, :, None] & real[:, None, :]
    away = np.where(both, np.where(away == 0, 1e-300, away), 1.0)
    # The vector whose update has exactly these roots: eigenvectors made of it are orthogonal.
    between = poles[:, :, None] - poles[:, None, :]
    between[:, j, j] = 1.0
    ratio = np.where(both, away / np.where(between == 0, 1.0, between), 1.0)
    touched = np.where(real, np.copysign(np.sqrt(np.abs(ratio.prod(axis=2))), z), 0.0)
    turn = np.where(both, touched[:, :, None] / away, 0.0)
    norm = np.sqrt((turn * turn).sum(axis=1, keepdims=True))
    turn /= np.where(norm == 0, 1.0, norm)
    turn += np.eye(d) * ~real[:, None, :]
    return new, np.matmul(vectors, turn)


def diagonal(h: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of a symmetric matrix by rotations of two axes at a time."""
    h, d = h.copy(), len(h)
    turn = np.eye(d)
    for _ in range(sweeps):
        quiet = True
        for p in range(d - 1):
            for q in range(p + 1, d):
                if abs(h[p, q]) <= EPS * np.sqrt(abs(h[p, p] * h[q, q])) or h[p, q] == 0:
                    continue
                quiet = False
                theta = (h[q, q] - h[p, p]) / (2 * h[p, q])
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1))
                c = 1 / np.hypot(t, 1)
                s = t * c
                for m in (h.T, h, turn.T):  # columns of h, rows of h, columns of turn
                    m[p], m[q] = c * m[p] - s * m[q], s * m[p] + c * m[q]
                h[p, q] = h[q, p] = 0.0
        if quiet:
            break
    order = np.argsort(-np.diag(h), kind="stable")
    return np.diag(h)[order], turn[:, order]


def _whole(dimension: int):
    """The vectors that take part, as packed whole numbers."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            right = pc.fill_null(pc.equal(pc.list_value_length(lists), dimension), False)
            ids, lists = ids.filter(right), lists.filter(right)
            x = np.asarray(pc.list_flatten(lists).cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimension)
            good = np.isfinite(x).all(axis=1)
            x = np.clip(np.floor(SCALE * x[good]) + SHIFT, -(2.0**62), 2.0**62).astype("<i8")
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), pa.array([v.tobytes() for v in x], pa.binary())], names=[batch.schema.names[0], "x"])

    return whole


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), "<i8").reshape(len(blobs), dimension)


_SPECTRUM = "part int, n long, low array<bigint>, high array<bigint>, spectrum binary"


def _spectrum_row(part: int, n: int, low: np.ndarray, high: np.ndarray, spectrum: Spectra) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([low.tolist()], longs), pa.array([high.tolist()], longs), pa.array([spectrum.packed()], pa.binary())],
        names=["part", "n", "low", "high", "spectrum"],
    )


def _spectrum(dimension: int):
    """The spectrum of one task's vectors, and their sum by the lower and the higher bits of the numbers."""

    def spectrum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains, n = Spectra.empty(CHAINS, dimension), 0
        low, high = np.zeros(dimension, np.int64), np.zeros(dimension, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), dimension)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            high += (x >> 32).sum(axis=0)
            n += len(x)
            for at in range(0, len(x), CHAINS):
                chains.add(x[at : at + CHAINS].astype(float))
        if n:
            yield _spectrum_row(TaskContext.get().partitionId(), n, low, high, chains.one())

    return spectrum


def _combine(dimension: int):
    def combine(table: pa.Table) -> pa.Table:
        one = Spectra.unpacked(table.column("spectrum").to_pylist(), dimension).one()
        # The sums of whole numbers go by Spark; here they are only carried on.
        none = np.zeros(dimension, np.int64)
        return pa.Table.from_batches([_spectrum_row(table.column("part")[0].as_py() // FAN_IN, 0, none, none, one)])

    return combine


def _exact(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums in whole numbers, of any length if need be."""
    if n * int(np.abs(x).max(initial=0)) < 2**61 and max(map(abs, sums)) < 2**61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _moments(dimension: int, n: int, sums: list[int], basis: np.ndarray):
    """The sums of products of the centred vectors' coordinates in ``basis``, upper half."""
    rows, cols = np.triu_indices(dimension)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, dimension))
        for batch in batches:
            y = (_exact(_matrix(batch.column("x"), dimension), n, sums) / n).astype(float) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(cols.astype(np.int32)), pa.array(total[rows, cols])], names=["i", "j", "s"])

    return moments


def _whitened(dimension: int, n: int, sums: list[int], axes: np.ndarray, values: np.ndarray, id_name: str):
    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = np.array([1 / np.sqrt(e) if e > 0 else 0.0 for e in values])
        for batch in batches:
            exact = _exact(_matrix(batch.column("x"), dimension), n, sums)
            if int(np.abs(exact).max(initial=0)) ** 2 * dimension < 2**62:
                deviation = (exact.astype(np.int64) ** 2).sum(axis=1).tolist()
            else:
                deviation = [s if s < 2**63 else None for s in (sum(int(v) ** 2 for v in row) for row in exact)]
            w = ((exact / n).astype(float) @ axes) * spread
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists], names=[id_name, "deviation", "whitened"])

    return whitened


def principal_axes(rows: DataFrame, dimension: int) -> tuple[int, list[int], np.ndarray, np.ndarray]:
    """From packed vectors ``x``: their number, exact sums, eigenvalues of their covariance, falling, and the unit
    eigenvectors as columns."""
    folder = shared_folder(rows.sparkSession)
    parts = stored(rows.select("x").mapInArrow(_spectrum(dimension), _SPECTRUM), folder, "spectra")
    n, last = parts.agg(F.sum("n"), F.max("part")).first()
    if not n:
        return 0, [0] * dimension, np.zeros(dimension), np.eye(dimension)
    sums = parts.select(F.posexplode(F.arrays_zip("low", "high")).alias("k", "s")).groupBy("k").agg(*[F.sum(F.col(f"s.{c}").cast("decimal(38,0)")).alias(c) for c in ("low", "high")])
    sums = [int(r["low"]) + (int(r["high"]) << 32) for r in sums.orderBy("k").collect()]  # a row a dimension
    turn = 0
    while last > 0:
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(_combine(dimension), _SPECTRUM)
        last, turn = last // FAN_IN, turn + 1
        parts = stored(parts, folder, f"spectra-{turn}")
    basis = Spectra.unpacked([parts.first()["spectrum"]], dimension).vectors[0]
    products = rows.select("x").mapInArrow(_moments(dimension, n, sums, basis), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    h = np.zeros((dimension, dimension))
    h[products.column("i").to_numpy(), products.column("j").to_numpy()] = products.column("s").to_numpy() / n
    h = np.where(h == 0, h.T, h)
    values, turned = diagonal(h)
    return n, sums, values, np.einsum("ij,jk->ik", basis, turned)


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) of every vector that takes part and each of
    the ``components`` first principal components (all, if the vectors are shorter).

    Rows whose vector is null or holds null or non-finite entries are left out, and so are vectors of another length than
    the most common one (the shorter, of two). Entries are scaled, rounded down and shifted to whole numbers
    (``SCALE``, ``SHIFT``), up to 2**62. ``deviation`` is null above 2**63. A component without variance, as with one
    vector or equal ones, has ``whitened`` and ``explained`` 0 and is left out of ``identity_error``. Repeated rows
    count as often as they come, rows without an id take part, other columns are ignored; without vectors no row is
    returned.
    """
    rows = vectors.select(F.col(id_col), F.col(vector_col).alias("x"))
    lengths = rows.where("x is not null").groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dimension = max(1, lengths["n"]) if lengths else 1
    kind = rows.schema[id_col].dataType.simpleString()
    rows = rows.mapInArrow(_whole(dimension), f"`{id_col}` {kind}, x binary")
    n, sums, values, axes = principal_axes(rows, dimension)
    k, trace = min(components, dimension), float(values.sum())
    values = np.where(values > NOTHING * trace, values, 0.0)[:k]
    out = rows.mapInArrow(_whitened(dimension, n, sums, np.ascontiguousarray(axes[:, :k]), values, id_col), f"`{id_col}` {kind}, deviation long, whitened array<double>")
    out = stored(out, shared_folder(vectors.sparkSession), "whitened")
    pairs = [(i, j) for i in range(k) for j in range(i, k) if values[i] > 0 and values[j] > 0]
    error = 0.0
    if pairs and n:
        w = F.col("whitened")
        row = out.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    share = F.array(*[F.lit(float(e / trace) if trace > 0 else 0.0) for e in values])
    out = out.select(id_col, "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return out.select(
        id_col,
        (F.col("_k") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        share[F.col("_k")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
