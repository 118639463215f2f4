"""The rows of some symbols in order, as numpy columns, in one Python task.

A sliding window reads its frame anew for every row; here a frame of n rows is n additions of whole columns. Operators
that are written for both take a ``Stack`` where they take a DataFrame: ``tools`` gives them the functions and columns
of either, and the window primitives in ``timeseries`` work on ``Cells`` as on columns. Nulls, NaN (greater than any
number) and sums in row order are as in Spark, so results are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a stack, about: whole symbols, each bounded by the calendar.
STACK_ROWS = 32_768
NUMBERS = {"double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "date": pa.date32(), "boolean": pa.bool_()}
_STORED = {"double": np.float64, "int": np.int32, "bigint": np.int64, "date": np.int32, "boolean": bool}


def _and(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a if a is b else a & b


def _before(a, b):
    """a < b, where NaN is the greatest number."""
    return (a < b) | (~np.isnan(a) & np.isnan(b))


class Cells:
    """A column: values, which of them are not null, and its SQL type."""

    def __init__(self, stack: Stack, v: np.ndarray, ok: np.ndarray, kind: str = "double", name: str = ""):
        self.stack, self.v, self.ok, self.kind, self.name = stack, v, ok, kind, name

    def alias(self, name: str) -> Cells:
        return Cells(self.stack, self.v, self.ok, self.kind, name)

    def cast(self, kind: str) -> Cells:
        return Cells(self.stack, self.v.astype(_STORED[kind]), self.ok, kind)

    def cells(self, x) -> Cells:
        return x if isinstance(x, Cells) else self.stack.lit(x)

    def _with(self, fn: Callable, other, kind: str = "double", turned: bool = False) -> Cells:
        v, ok = (other.v, _and(self.ok, other.ok)) if isinstance(other, Cells) else (other, self.ok)
        return Cells(self.stack, fn(v, self.v) if turned else fn(self.v, v), ok, kind)

    def __add__(self, x): return self._with(np.add, x)
    def __radd__(self, x): return self._with(np.add, x, turned=True)
    def __sub__(self, x): return self._with(np.subtract, x)
    def __rsub__(self, x): return self._with(np.subtract, x, turned=True)
    def __mul__(self, x): return self._with(np.multiply, x)
    def __rmul__(self, x): return self._with(np.multiply, x, turned=True)
    def __mod__(self, x): return self._with(np.fmod, x, self.kind)
    def __neg__(self): return Cells(self.stack, -self.v, self.ok)
    def __lt__(self, x): return self._with(_before, x, "boolean")
    def __gt__(self, x): return self._with(_before, x, "boolean", turned=True)
    def __ge__(self, x): return ~(self < x)
    def __le__(self, x): return ~(self > x)
    def __eq__(self, x): return self._with(lambda a, b: (a == b) | (np.isnan(a) & np.isnan(b)), x, "boolean")
    def __invert__(self): return Cells(self.stack, ~self.v, self.ok, "boolean")
    def __truediv__(self, x): return self.over_(x, self.stack.strict)
    def __rtruediv__(self, x): return self.cells(x).over_(self, self.stack.strict)

    def over_(self, x, strict: bool = False) -> Cells:
        """Divided by x; null where that is 0, or an error if ``strict``."""
        x = self.cells(x)
        ok, zero = _and(self.ok, x.ok), x.v == 0
        if zero.any():
            if strict and (ok & zero).any():
                raise ZeroDivisionError("division by zero")
            ok = ok & ~zero
        return Cells(self.stack, self.v / x.v, ok)

    def __and__(self, x) -> Cells:
        x = self.cells(x)
        false = (self.ok & ~self.v) | (x.ok & ~x.v)
        return Cells(self.stack, ~false, (self.ok & x.ok) | false, "boolean")

    __rand__ = __and__

    def __or__(self, x) -> Cells:
        x = self.cells(x)
        true = (self.ok & self.v) | (x.ok & x.v)
        return Cells(self.stack, true, (self.ok & x.ok) | true, "boolean")

    def isNotNull(self) -> Cells:
        return Cells(self.stack, self.ok, self.stack.all, "boolean")

    def isNull(self) -> Cells:
        return Cells(self.stack, ~self.ok, self.stack.all, "boolean")

    # -- windows over the symbol's rows, in order

    def lag(self, k: int) -> Cells:
        v, ok = np.roll(self.v, k), np.roll(self.ok, k) & self.stack.has(k)
        return Cells(self.stack, v, ok, self.kind)

    def _last_seen(self) -> np.ndarray:
        """Place of the last value that is not null, up to each row; before the symbol's first row without one."""
        return np.maximum.accumulate(np.where(self.ok, self.stack.at, -1))

    def _rows_seen(self) -> np.ndarray:
        """How many rows up to each row have a value, without a null between them."""
        if self.ok is self.stack.all:
            return self.stack.at - self.stack.first + 1
        gap = np.maximum.accumulate(np.where(self.ok, -1, self.stack.at))
        return self.stack.at - np.maximum(gap, self.stack.first - 1)

    def ffill(self) -> Cells:
        at = self._last_seen()
        return Cells(self.stack, self.v[np.maximum(at, 0)], at >= self.stack.first, self.kind)

    def bfill(self) -> Cells:
        n = len(self.v)
        at = np.minimum.accumulate(np.where(self.ok, self.stack.at, n)[::-1])[::-1]
        return Cells(self.stack, self.v[np.minimum(at, n - 1)], at <= self.stack.last, self.kind)

    def before(self) -> Cells:
        """The last value before the row."""
        return self.lag(1).ffill()

    def running(self, starts: np.ndarray | None = None) -> Cells:
        """Sum so far, since the last of ``starts``; a symbol's first row if there are none."""
        starts = self.stack.starts if starts is None else starts
        v, ends = np.where(self.ok, self.v, 0.0), np.append(starts[1:], len(self.v))
        for a, z in zip(starts.tolist(), ends.tolist()):
            np.add.accumulate(v[a:z], out=v[a:z])
        return Cells(self.stack, v, self._last_seen() >= np.repeat(starts, ends - starts))

    def rolling(self, fn: str, n: int) -> Cells:
        """``fn`` over the last n rows, null until they hold n values; the rows are taken in their order."""
        size = len(self.v) - n + 1
        out = np.zeros(len(self.v))
        if size > 0:
            rows = (self.v[k : k + size] for k in range(n))
            out[n - 1 :] = _FRAMES[fn](rows, size, n)
        return Cells(self.stack, out, self._rows_seen() >= n)


def _sum(rows: Iterator[np.ndarray], size: int, n: int) -> np.ndarray:
    out = np.zeros(size)
    for x in rows:
        out += x
    return out


def _deviation(rows: Iterator[np.ndarray], size: int, n: int) -> np.ndarray:
    """Sample deviation by Welford's updates, as Spark computes it."""
    mean, square = np.zeros(size), np.zeros(size)
    for k, x in enumerate(rows, 1):
        delta = x - mean
        step = delta / k
        mean += step
        square += delta * (delta - step)
    return np.sqrt(square / (n - 1)) if n > 1 else np.full(size, np.nan)


_FRAMES = {
    "sum": _sum,
    "avg": lambda rows, size, n: _sum(rows, size, n) / n,
    "stddev_samp": _deviation,
    "min": lambda rows, size, n: reduce(np.fmin, rows),
    "max": lambda rows, size, n: reduce(np.maximum, rows),
}


class _When(Cells):
    def __init__(self, hit: Cells, then):
        then = hit.cells(then)
        self.hit = hit.v & hit.ok
        super().__init__(hit.stack, then.v, then.ok & self.hit, then.kind)

    def otherwise(self, x) -> Cells:
        x = self.cells(x)
        kind = "double" if "double" in (self.kind, x.kind) else self.kind
        return Cells(self.stack, np.where(self.hit, self.v, x.v), np.where(self.hit, self.ok, x.ok), kind)


def _function(fn: Callable) -> Callable:
    def of(x):
        return Cells(x.stack, fn(x.v), x.ok) if isinstance(x, Cells) else float(fn(x))

    return of


def _extreme(fn: Callable) -> Callable:
    """Nulls are left out."""

    def of_two(a: Cells, b: Cells) -> Cells:
        v = np.where(a.ok & b.ok, fn(a.v, b.v), np.where(a.ok, a.v, b.v))
        return Cells(a.stack, v, a.ok | b.ok)

    return lambda *xs: reduce(of_two, xs)


def _coalesce(first: Cells, *rest) -> Cells:
    out = first
    for x in map(first.cells, rest):
        out = Cells(out.stack, np.where(out.ok, out.v, x.v), out.ok | x.ok, out.kind)
    return out


def _months(x: Cells) -> np.ndarray:
    return x.v.astype("datetime64[D]").astype("datetime64[M]")


class Functions:
    """The functions of a Stack, by their names in Spark."""

    lit = staticmethod(lambda x: x)
    when = _When
    coalesce = staticmethod(_coalesce)
    greatest, least = staticmethod(_extreme(np.maximum)), staticmethod(_extreme(np.fmin))
    abs, signum, sqrt, exp = (staticmethod(_function(f)) for f in (np.abs, np.sign, np.sqrt, np.exp))
    try_divide = staticmethod(lambda a, b: (a if isinstance(a, Cells) else b.cells(a)).over_(b))
    floor = staticmethod(lambda x: x.cast("bigint") if x.kind != "double" else Cells(x.stack, np.floor(x.v), x.ok))

    @staticmethod
    def log(x: Cells) -> Cells:
        return Cells(x.stack, np.log(x.v), x.ok & (x.v > 0))

    @staticmethod
    def pow(a, b) -> Cells:
        known = b if isinstance(b, Cells) else a
        return known.cells(a)._with(np.power, b)

    @staticmethod
    def month(x: Cells) -> Cells:
        return Cells(x.stack, _months(x).astype(np.int64) % 12 + 1, x.ok, "int")

    @staticmethod
    def last_day(x: Cells) -> Cells:
        return Cells(x.stack, (_months(x) + 1).astype("datetime64[D]").astype(np.int64) - 1, x.ok, "date")


class _Other(Cells):
    """A column that is only passed on; ``v`` is an Arrow array."""

    def alias(self, name: str) -> Cells:
        return _Other(self.stack, self.v, self.ok, self.kind, name)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def arrays(columns: list, stack: Stack) -> Cells:
    """Columns without nulls as one array a row."""
    values = np.column_stack([stack.lit(x).v if not isinstance(x, Cells) else x.v for x in columns]).astype(np.float64)
    ends = np.arange(len(values) + 1, dtype=np.int32) * len(columns)
    return _Other(stack, pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel())), stack.all, "array<double>")


class Rows:
    """What a last step makes of a Stack that are no rows of its own."""

    def __init__(self, batch: pa.RecordBatch | None, dtypes: list[tuple[str, str]]):
        self.batch, self.dtypes = (lambda: batch), dtypes


class Stack:
    """Columns over the ordered rows of some symbols, with the methods of a DataFrame that the operators use."""

    def __init__(self, sizes: np.ndarray, strict: bool):
        self.strict, self._cells, self._known = strict, {}, {}
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        self.sizes, self.starts, self.at = sizes, ends - sizes, np.arange(n)
        self.first, self.last = np.repeat(self.starts, sizes), np.repeat(ends - 1, sizes)
        self.all = np.ones(n, bool)

    @classmethod
    def of(cls, table: pa.Table, kinds: dict[str, str], sizes: np.ndarray, strict: bool) -> Stack:
        out = cls(sizes, strict)
        for name, kind in kinds.items():
            column = table.column(name).combine_chunks()
            column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
            ok = column.is_valid().to_numpy(zero_copy_only=False) if column.null_count else out.all
            if kind in NUMBERS:
                column = column.cast(pa.int32()) if kind == "date" else column
                v = column.fill_null(False if kind == "boolean" else 0).to_numpy(zero_copy_only=False)
                out._cells[name] = Cells(out, v, ok, kind, name)
            else:
                out._cells[name] = _Other(out, column, ok, kind, name)
        out._known.update(out._cells)
        return out

    @property
    def columns(self) -> list[str]:
        return list(self._cells)

    @property
    def dtypes(self) -> list[tuple[str, str]]:
        return [(n, x.kind) for n, x in self._cells.items()]

    def column(self, name: str) -> Cells:
        """By its name, as last defined on these rows: an operator asks for columns that it adds on the way."""
        return self._known[name.strip("`")]

    def lit(self, x) -> Cells:
        kind = "boolean" if isinstance(x, bool) else "int" if isinstance(x, int) else "double"
        if x is None:
            return Cells(self, np.zeros(len(self.at)), ~self.all)
        return Cells(self, np.full(len(self.at), x, _STORED[kind]), self.all, kind)

    def strings(self, name: str) -> list:
        """A column's values as text."""
        x = self.column(name)
        if isinstance(x, _Other):
            return x.v.cast(pa.string()).to_pylist()
        array = pa.array(x.v, pa.int32() if x.kind == "date" else NUMBERS[x.kind], mask=~x.ok)
        return (array.cast(pa.date32()) if x.kind == "date" else array).cast(pa.string()).to_pylist()

    def has(self, k: int) -> np.ndarray:
        """Rows that have a k-th row before them, or after them for k < 0."""
        return self.at - self.first >= k if k >= 0 else self.last - self.at >= -k

    def row_number(self) -> Cells:
        return Cells(self, self.at - self.first + 1, self.all, "int")

    def row_number_from_end(self) -> Cells:
        return Cells(self, self.last - self.at + 1, self.all, "int")

    def row_number_by(self, label: Cells, keys: list[np.ndarray]) -> tuple[Cells, Cells]:
        """Numbers of the rows of a symbol and label in the order of ``keys``, and how many these are."""
        value = np.where(label.ok, label.v.astype(float), -np.inf)
        order = np.lexsort([*keys[::-1], value, self.first])
        new = np.ones(len(order), bool)
        new[1:] = (value[order[1:]] != value[order[:-1]]) | (self.first[order[1:]] != self.first[order[:-1]])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(order)))
        number, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        number[order], size[order] = self.at - np.repeat(starts, sizes) + 1, np.repeat(sizes, sizes)
        return Cells(self, number, self.all, "bigint"), Cells(self, size, self.all, "bigint")

    def rows_of_symbol(self) -> Cells:
        return Cells(self, np.repeat(self.sizes, self.sizes), self.all, "bigint")

    def _having(self, cells: dict[str, Cells]) -> Stack:
        out = object.__new__(Stack)
        out.__dict__.update(self.__dict__)
        out._cells = cells
        return out

    def withColumns(self, new: dict) -> Stack:
        made = {n: (x if isinstance(x, Cells) else self.lit(x)).alias(n) for n, x in new.items()}
        self._known.update(made)
        return self._having(self._cells | made)

    def withColumn(self, name: str, x) -> Stack:
        return self.withColumns({name: x})

    def select(self, *columns) -> Stack:
        chosen = [self.column(x) if isinstance(x, str) else x for x in columns]
        out = self._having({x.name: x for x in chosen})
        out._known.update(out._cells)
        return out

    def drop(self, *names: str) -> Stack:
        return self._having({n: x for n, x in self._cells.items() if n not in names})

    def filter(self, keep: Cells) -> Stack:
        hit = keep.v & keep.ok
        sizes = np.add.reduceat(hit, self.starts, dtype=np.int64) if len(self.starts) else self.sizes
        out = Stack(sizes[sizes > 0], self.strict)
        for n, x in self._cells.items():
            v = x.v.filter(pa.array(hit)) if isinstance(x, _Other) else x.v[hit]
            out._cells[n] = type(x)(out, v, out.all if x.ok is self.all else x.ok[hit], x.kind, n)
        out._known.update(out._cells)
        return out

    def batch(self) -> pa.RecordBatch:
        columns = []
        for x in self._cells.values():
            if isinstance(x, _Other):
                columns.append(x.v)
            else:
                stored = pa.int32() if x.kind == "date" else NUMBERS[x.kind]
                array = pa.array(x.v.astype(_STORED[x.kind], copy=False), stored, mask=None if x.ok is self.all else ~x.ok)
                columns.append(array.cast(pa.date32()) if x.kind == "date" else array)
        return pa.RecordBatch.from_arrays(columns, names=self.columns)


def tools(df) -> tuple:
    """The functions and columns of a DataFrame or a Stack."""
    return (Functions, df.column) if isinstance(df, Stack) else (F, F.col)


def _symbol_sizes(symbols: pa.ChunkedArray) -> np.ndarray:
    ids = symbols.combine_chunks().dictionary_encode()
    ids = ids if isinstance(ids, pa.DictionaryArray) else ids.combine_chunks()
    ids = ids.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
    return np.diff(edges)


def narrowed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only these columns, but a result of ``over_symbols`` as it is: work over its symbols takes no columns from it."""
    return df if hasattr(df, "_over_symbols") else df.select(*[F.col(f"`{n}`") for n in columns])


def fits_stacks(df: DataFrame) -> bool:
    """Whether a Stack can compute with all columns."""
    return all(kind in {*NUMBERS, "string"} for _, kind in df.dtypes)


def over_symbols(df: DataFrame, work: Callable, numbers: list[str], rows: int | None = None) -> DataFrame:
    """``work`` on the rows of each symbol in the order of their dates: one exchange and one sort, whatever it computes.

    ``work`` takes and returns a Stack, and works on a DataFrame just as well; it does so where one of ``numbers``, the
    columns it computes with, is no double. A task holds some ten symbols at a time, about ``rows`` rows. Work over the
    symbols of a result of this function goes into the same pass.
    """
    kinds = dict(df.dtypes)
    if any(kinds[n] != "double" for n in numbers if n in kinds):
        return work(df)
    rows = rows or STACK_ROWS
    if earlier := getattr(df, "_over_symbols", None):
        (df, first), last = earlier, work
        work, kinds = lambda x: last(first(x)), dict(df.dtypes)
    strict = df.sparkSession.conf.get("spark.sql.ansi.enabled") == "true"
    types = {f.name: f.dataType for f in df.schema}

    def worked(table: pa.Table, sizes: np.ndarray) -> Stack:
        with np.errstate(all="ignore"):
            return work(Stack.of(table, kinds, sizes, strict))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            table = pa.Table.from_batches(held)
            sizes = _symbol_sizes(table.column("symbol"))
            if not last:  # more rows of the last symbol may follow
                sizes = sizes[:-1]
            n = int(sizes.sum())
            if n:
                out = worked(table.slice(0, n), sizes).batch()
                if out is not None and out.num_rows:
                    yield out
            held, size = table.slice(n).to_batches(), table.num_rows - n

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
                if size >= rows:
                    yield from ready(False)
        if size:
            yield from ready(True)

    nothing = pa.table({n: pa.array([], NUMBERS.get(kind, pa.null())) for n, kind in kinds.items()})
    schema = T.StructType([
        T.StructField(n, types[n] if n in types and kinds[n] == kind else T._parse_datatype_string(kind))
        for n, kind in worked(nothing, np.zeros(0, np.int64)).dtypes
    ])
    out = df.repartition("symbol").sortWithinPartitions("symbol", "date").mapInArrow(run, schema)
    out._over_symbols = df, work
    return out
