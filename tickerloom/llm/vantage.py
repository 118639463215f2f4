"""Approximate nearest neighbours by inner product: a vantage-point tree for each shard.

As in the exact search, one more component turns the largest inner product into the nearest neighbour. A shard is a part
of the rows by hash; its tree halves them again and again by their distance to a vantage point. A search goes down the
nearer half first and enters the other one only if the triangle inequality allows a nearer row there; ``factor`` relaxes
this: the distance to beat is divided by it, so 1 gives the exact result and more skips more. Queries go through a tree
in blocks, so the work is done on matrices.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import shared_folder, stored
from .vectors import best_of, matrix, usable_vectors

#: Rows of a shard on average, of a leaf at most, and queries of a block on average.
SHARD = 4096
LEAF = 128
BLOCK = 512
FACTOR = 1.1


def build_tree(x: np.ndarray, leaf: int = LEAF, seed: int = 11) -> list[tuple]:
    """Nodes ("leaf", rows) or ("split", row of the vantage point, radius, inner node, outer node); the last is the root.

    The vantage point is one of a few rows, that whose distances to some others spread most."""
    rng, nodes = np.random.default_rng(seed), []

    def grow(rows: np.ndarray) -> int:
        if len(rows) <= leaf:
            nodes.append(("leaf", rows))
            return len(nodes) - 1
        some = x[rng.choice(rows, min(len(rows), 64), replace=False)]
        tries = rng.choice(rows, min(len(rows), 4), replace=False)
        v = int(max(tries, key=lambda t: np.linalg.norm(some - x[t], axis=1).var()))
        rest = rows[rows != v]
        d = np.linalg.norm(x[rest] - x[v], axis=1)
        order = np.argsort(d, kind="stable")
        half = len(rest) // 2
        inner, outer = grow(rest[order[:half]]), grow(rest[order[half:]])
        nodes.append(("split", v, float(d[order[half]]), inner, outer))
        return len(nodes) - 1

    grow(np.arange(len(x)))
    return nodes


def search_tree(nodes: list[tuple], x: np.ndarray, q: np.ndarray, longest: float, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """For each query the k best rows of ``x`` (original vectors) and their inner products; -1 and -inf fill up."""
    best, rows = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
    length = np.einsum("ij,ij->i", q, q)

    def offer(who: np.ndarray, candidates: np.ndarray, score: np.ndarray) -> None:
        value = np.concatenate([best[who], score], axis=1)
        name = np.concatenate([rows[who], np.broadcast_to(candidates, score.shape)], axis=1)
        order = np.lexsort((name, -value), axis=1)[:, :k]
        best[who], rows[who] = np.take_along_axis(value, order, 1), np.take_along_axis(name, order, 1)

    def reach(who: np.ndarray) -> np.ndarray:
        """Distance to the k-th best row so far."""
        return np.sqrt(np.maximum(length[who] + longest - 2 * best[who, -1], 0))

    def visit(at: int, who: np.ndarray) -> None:
        if not len(who):
            return
        node = nodes[at]
        if node[0] == "leaf":
            offer(who, node[1], q[who] @ x[node[1]].T)
            return
        _, v, radius, inner, outer = node
        score = q[who] @ x[v]
        offer(who, np.array([v]), score[:, None])
        d = np.sqrt(np.maximum(length[who] + longest - 2 * score, 0))
        inside = d < radius
        visit(inner, who[inside])
        visit(outer, who[~inside])
        gap = np.abs(d - radius) <= reach(who) / factor + 1e-9
        visit(outer, who[inside & gap])
        visit(inner, who[~inside & gap])

    visit(len(nodes) - 1, np.arange(len(q)))
    return best, rows


def _index(dimension: int, longest: float, k: int):
    """One shard's tree over its different vectors; of equal ones, the k + 1 smallest ids can be in a result."""

    def index(table: pa.Table) -> pa.Table:
        ids, x = table.column("vec_id").to_numpy(), matrix(table.column("v"), dimension)
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])
        group = np.cumsum(new) - 1
        rank = np.arange(len(ids)) - np.flatnonzero(new)[group]
        kept = rank <= k
        x = x[new]
        lifted = np.column_stack([x, np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", x, x), 0))])
        blob = pickle.dumps((x, build_tree(lifted), ids[kept], np.searchsorted(group[kept], np.arange(len(x) + 1))))
        return pa.table({"shard": table.column("shard")[:1], "tree": pa.array([blob], pa.large_binary()).cast(pa.binary())})

    return index


def build_index(rows: DataFrame, dimension: int, longest: float, k: int, shards: int) -> DataFrame:
    """(shard, tree) over all rows (vec_id, v); a shard holds SHARD rows on average whatever the number of rows."""
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v")
    return dealt.groupBy("shard").applyInArrow(_index(dimension, longest, k), "shard int, tree binary")


def _block(table: pa.Table) -> pa.Table:
    ids = table.column("vec_id").to_numpy().astype("<i8").tobytes()
    return pa.table({"block": table.column("block")[:1], "ids": [ids], "vs": [b"".join(table.column("v").to_pylist())]})


def _search(dimension: int, longest: float, k: int, factor: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tree, asks, q = (batch.column(c)[row].as_py() for c in ("tree", "ids", "vs"))
                x, nodes, ids, start = pickle.loads(tree)
                asks, q = np.frombuffer(asks, "<i8"), np.frombuffer(q, "<f8").reshape(-1, dimension)
                _, found = search_tree(nodes, x, q, longest, k + 1, factor)
                who, place = np.nonzero(found >= 0)
                at = found[who, place]
                score = (q[who] * x[at]).sum(axis=1)  # summed alike for all, so that equal vectors tie
                n = start[at + 1] - start[at]
                name = ids[np.repeat(start[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                who, score = np.repeat(who, n), np.repeat(score, n)
                other = name != asks[who]
                who, score, name = who[other], score[other], name[other]
                order = np.lexsort((name, -score, who))
                who, score, name = who[order], score[order], name[order]
                top = np.arange(len(who)) - np.searchsorted(who, who) < k
                yield pa.RecordBatch.from_arrays([pa.array(asks[who[top]]), pa.array(name[top]), pa.array(score[top])], names=["query_id", "vec_id", "score"])

    return search


def vantage_top_k(table: DataFrame, k: int, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): about the ``k`` largest inner products of each query with the other rows, ties
    to the smaller id; exactly those if ``factor`` is 1. ``asks`` is a condition on ``vec_id`` that tells the queries.

    Which rows take part: see ``usable_vectors``; vectors of zeros do not. Ids should be unique: a query leaves out all
    rows of its id. No rows or queries: no result.
    """
    spark, folder = table.sparkSession, shared_folder(table.sparkSession)
    rows, dimension = usable_vectors(table, id_col, vector_col, zero=False)
    rows = stored(rows.withColumn("asks", asks), folder, "rows")
    n, longest, questions = rows.agg(F.count("*"), F.max("norm"), F.sum(F.col("asks").cast("long"))).first()
    if not n or not questions:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards, blocks = -(-n // SHARD), -(-questions // BLOCK)
    index = stored(build_index(rows, dimension, longest, k, shards), folder, "index")
    queries = rows.where("asks").select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")
    queries = queries.groupBy("block").applyInArrow(_block, "block int, ids binary, vs binary")
    asked = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    found = asked.join(index, "shard").select("tree", "ids", "vs").mapInArrow(_search(dimension, longest, k, factor), "query_id long, vec_id long, score double")
    return best_of(found, k)
