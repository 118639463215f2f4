"""Exact top-k inner products as a Voronoi kNN join.

One more component makes all data vectors equally long, so that the largest inner product is the nearest neighbour:
|q' - s'|^2 = |q|^2 + M - 2 q.s. Pivots cut the space into cells. A first pass over the data leaves each cell's number of
rows and its smallest distances to the pivot; from these follows, for each cell of queries, a distance within which k
neighbours lie for certain. A data row goes only to the groups of query cells that it can be in reach of, by the triangle
inequality. Each group's data is cut into blocks by hash, so a common vector fills many blocks a little; a block finds
its best rows for all queries of the group, and the best of the blocks are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import shared_folder, stored
from .vectors import best_of, matrix, usable_vectors

#: Pivots at most; there are about the square root of the number of queries.
MAX_PIVOTS = 1024
#: Queries of a group, and data rows of a block, at most (blocks: on average).
GROUP = 1024
BLOCK = 4096


def _lift(x: np.ndarray, norm: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(longest - norm, 0))])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0))


def _cells(pivots: np.ndarray, longest: float, dimension: int):
    """Adds the nearest pivot and the distance to it, as a data row and as a query."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, norm = matrix(batch.column("v"), dimension), batch.column("norm").to_numpy()
            out = []
            for lifted in (_lift(x, norm, longest), np.column_stack([x, np.zeros(len(x))])):
                d = _distances(lifted, pivots)
                cell = d.argmin(axis=1)
                out += [pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])]
            asks = batch.column("asks")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), asks, *out], names=["vec_id", "v", "asks", "cell", "d", "qcell", "qd"])

    return cells


def _nearest(k: int):
    """The k smallest distances of each cell in one task."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            cell, d = batch.column("cell").to_numpy(), batch.column("d").to_numpy()
            for c in np.unique(cell):
                best[int(c)] = np.sort(np.append(best.get(int(c), []), d[cell == c]))[:k]
        for c, d in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), c, np.int32)), pa.array(d)], names=["cell", "d"])

    return nearest


def _plan(pivots: np.ndarray, near: dict[int, list[float]], data: dict[int, int], asked: dict[int, tuple[int, float]], k: int, slack: float):
    """Groups of query cells with, for each data cell, the least and the greatest distance to its pivot of rows that
    may be needed: (cells, splits by queries, data blocks, lower bounds, upper bounds)."""
    # By rows and without linear algebra, whose threads may wait for ever on the driver.
    between = np.array([np.sqrt(((pivots - p) ** 2).sum(axis=1)) for p in pivots]).reshape(len(pivots), len(pivots))
    ring = {}
    for i, (_, radius) in asked.items():
        reach = sorted(radius + between[i, j] + d for j, ds in near.items() for d in ds)
        limit = reach[k] if len(reach) > k else np.inf  # one more, as the query itself may be among them
        ring[i] = (between[i] - radius - limit - slack, between[i] + radius + limit + slack)
    groups, order, left = [], [], set(asked)
    while left:  # cells in a chain of near neighbours
        i = min(left) if not order else min(left, key=lambda c: (between[order[-1], c], c))
        order.append(i)
        left.remove(i)
    for i in order:
        if groups and groups[-1][1] + asked[i][0] <= GROUP:
            groups[-1][0].append(i)
            groups[-1][1] += asked[i][0]
        else:
            groups.append([[i], asked[i][0]])
    out = []
    for cells, queries in groups:
        low = np.min([ring[i][0] for i in cells], axis=0)
        high = np.max([ring[i][1] for i in cells], axis=0)
        rows = sum(n for j, n in data.items() if high[j] >= 0)
        out.append((cells, -(-queries // GROUP), max(1, -(-rows // BLOCK)), low, high))
    return out


def _spread(plan, hash_seed: int = 7):
    """Data rows to (group, part, block) wherever they may be needed."""
    from .words import mix

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, d, ids = (batch.column(c).to_numpy() for c in ("cell", "d", "vec_id"))
            h = mix(ids.astype(np.uint64) + np.uint64(hash_seed))
            for g, (_, parts, blocks, low, high) in enumerate(plan):
                need = np.flatnonzero((d >= low[cell]) & (d <= high[cell]))
                if len(need):
                    block = (h[need] % np.uint64(blocks)).astype(np.int32)
                    rows = batch.select(["vec_id", "v"]).take(pa.array(need))
                    for p in range(parts):
                        where = [pa.array(np.full(len(need), x, np.int32)) for x in (g, p)]
                        yield pa.RecordBatch.from_arrays([*where, pa.array(block), *rows.columns], names=["g", "part", "block", "vec_id", "v"])

    return spread


def _ask(plan):
    """Queries to all blocks of their group and part."""
    from .words import mix

    of = {c: g for g, p in enumerate(plan) for c in p[0]}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = np.array([of[c] for c in batch.column("qcell").to_pylist()], np.int32)
            h = mix(batch.column("vec_id").to_numpy().astype(np.uint64))
            for g in np.unique(group):
                mine = np.flatnonzero(group == g)
                part = (h[mine] % np.uint64(plan[g][1])).astype(np.int32)
                rows = batch.select(["vec_id", "v"]).take(pa.array(mine))
                for block in range(plan[g][2]):
                    first = [pa.array(np.full(len(mine), g, np.int32)), pa.array(part), pa.array(np.full(len(mine), block, np.int32))]
                    yield pa.RecordBatch.from_arrays([*first, *rows.columns], names=["g", "part", "block", "vec_id", "v"])

    return ask


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _solve(k: int, dimension: int, exact: bool):
    """The k best rows of a block for each query, other than the query itself."""

    def solve(data: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if data.num_rows and queries.num_rows:
            ids, asks = data.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
            x, q = matrix(data.column("v"), dimension), matrix(queries.column("v"), dimension)
            for a in range(0, len(q), 256):
                part, who = q[a : a + 256], asks[a : a + 256]
                score = part @ x.T if exact else (part.astype(np.int64) @ x.T.astype(np.int64)).astype(np.float64)
                value = np.where(who[:, None] == ids[None, :], -np.inf, score)
                floor = np.partition(value, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(who), -np.inf)
                row, col = np.nonzero((value >= floor[:, None]) & (value > -np.inf))
                order = np.lexsort((ids[col], -value[row, col], row))
                row, col = row[order], col[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[rank < k], col[rank < k]
                got = value[row, col].astype(np.int64) if exact else np.einsum("ij,ij->i", part[row].astype(np.int64), x[col].astype(np.int64))
                out.append((who[row], ids[col], got))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], schema=_FOUND)

    return solve


def voronoi_top_k(table: DataFrame, k: int, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each query with the other rows, ties to the
    smaller id. ``asks`` is a condition on ``vec_id`` that tells the queries; components are floor(scale * x).

    Which rows take part: see ``usable_vectors``. Rows that repeat an id are one query each time and leave out all rows
    of that id, so ids should be unique. Products are exact while they stay below 2**63. No rows or queries: no result.
    """
    spark, folder = table.sparkSession, shared_folder(table.sparkSession)
    rows, dimension = usable_vectors(table, id_col, vector_col, scale)
    rows = stored(rows.withColumn("asks", asks), folder, "rows")
    n, longest, questions = rows.agg(F.count("*"), F.max("norm"), F.sum(F.col("asks").cast("long"))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n or not questions:
        return empty
    count = min(MAX_PIVOTS, max(1, round(questions**0.5)))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).select("v", "norm").toArrow()
    pivots = _lift(matrix(chosen.column("v"), dimension), chosen.column("norm").to_numpy(), longest)
    rows = stored(rows.mapInArrow(_cells(pivots, longest, dimension), "vec_id long, v binary, asks boolean, cell int, d double, qcell int, qd double"), folder, "cells")
    data = {r[0]: r[1] for r in rows.groupBy("cell").count().collect()}  # a row a pivot at most, as the next two
    asked = {r[0]: (r[1], r[2]) for r in rows.where("asks").groupBy("qcell").agg(F.count("*"), F.max("qd")).collect()}
    near = rows.select("cell", "d").mapInArrow(_nearest(k + 1), "cell int, d double")
    near = near.groupBy("cell").agg(F.slice(F.sort_array(F.collect_list("d")), 1, k + 1).alias("d"))
    near = {r[0]: r[1] for r in near.collect()}
    plan = _plan(pivots, near, data, asked, k, slack=1e-6 * (1 + float(longest) ** 0.5))
    schema = "g int, part int, block int, vec_id long, v binary"
    dealt = rows.select("vec_id", "v", "cell", "d").mapInArrow(_spread(plan), schema)
    queries = rows.where("asks").select("vec_id", "v", "qcell").mapInArrow(_ask(plan), schema)
    key, exact = ["g", "part", "block"], longest < 2**52
    found = dealt.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(_solve(k, dimension, exact), "query_id long, vec_id long, score long")
    return best_of(found, k)
