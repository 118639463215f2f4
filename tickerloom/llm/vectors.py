"""Vectors of a table as packed numbers, and the common parts of the two searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _rows(dimension: int, scale: float | None, zero: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            right = pc.and_(pc.is_valid(ids), pc.fill_null(pc.equal(pc.list_value_length(lists), dimension), False))
            ids, lists = ids.filter(right), lists.filter(right)
            flat = pc.list_flatten(lists)
            x = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimension)
            good = np.isfinite(x).all(axis=1)
            if not zero:
                good &= (x != 0).any(axis=1)
            x, ids = x[good], ids.filter(pa.array(good))
            if scale:
                x = np.floor(scale * x)
            x = np.ascontiguousarray(x, "<f8")
            norm = np.einsum("ij,ij->i", x, x)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([v.tobytes() for v in x], pa.binary()), pa.array(norm, pa.float64())], names=["vec_id", "v", "norm"]
            )

    return rows


def usable_vectors(table: DataFrame, id_col: str, vector_col: str, scale: float | None = None, zero: bool = True) -> tuple[DataFrame, int]:
    """(vec_id, v, norm) of the rows that take part, and the number of components: ``v`` packs doubles, scaled and
    rounded down if asked, ``norm`` is their squared length.

    Rows with a null id, a null vector, null or non-finite components or (if ``zero`` is False) only zeros are left out,
    and so are vectors of another length than the most common one (the smaller, of two).
    """
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    lengths = rows.where("vec_id is not null and v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dimension = max(1, lengths[0]) if lengths else 1
    return rows.mapInArrow(_rows(dimension, scale, zero), "vec_id long, v binary, norm double"), dimension


def matrix(column, dimension: int) -> np.ndarray:
    """The packed vectors of an Arrow column as rows."""
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), dimension)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query with their rank, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
