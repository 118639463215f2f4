"""Tables whose rows stay where they are: slices of some megabytes that small results are laid beside.

A join would move all texts to the results. Here a slice is known by its partition and its number in it. Results for it
are sent to the partition of the same number and the two are read side by side.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

from pyspark import RDD
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import give_back

#: Characters of text of a slice, and rows of one; a longer text makes a slice of its own.
SLICE, SLICE_ROWS = 3 << 19, 10_000


def text_of(path: list[str]):
    """The text of a row, a column or a field of a structure; null is as the empty text."""

    def text(row) -> str:
        for name in path:
            row = row[name]
        return row or ""

    return text


def _sliced(path: list[str]):
    text = text_of(path)

    def sliced(part: int, rows: Iterator) -> Iterator[tuple]:
        held, size, number = [], 0, 0
        for row in rows:
            held.append(row)
            size += len(text(row))
            if size >= SLICE or len(held) == SLICE_ROWS:
                yield part, number, held
                held, size, number = [], 0, number + 1
        if held:
            yield part, number, held
        held = []
        give_back()

    return sliced


def mark_of(texts: list[str]) -> int:
    """A checksum of the texts of a slice."""
    out = 0
    for text in texts:
        out = zlib.crc32(text.encode("utf-8", "surrogatepass") + b"\0", out)
    return out


def checked(rows: list, path: list[str], mark: int) -> list[str]:
    """The texts of a slice, which have the checksum ``mark``."""
    texts = list(map(text_of(path), rows))
    if mark_of(texts) != mark:
        raise RuntimeError("the rows came in another order than before: write the table first")
    return texts


def _gathered(rows: Iterator) -> Iterator[tuple]:
    """(part, slice, its rows) of rows in that order."""
    for (part, number), group in groupby(rows, key=lambda r: (r["part"], r["slice"])):
        yield part, number, list(group)


def _placed(path: list[str], id_col: str):
    def placed(item: tuple) -> Iterator[tuple]:
        part, number, rows = item
        texts = list(map(text_of(path), rows))
        mark = mark_of(texts)
        for k, row in enumerate(rows):
            yield part, number, mark, k, row[id_col]

    return placed


class Slices:
    """The slices of ``docs``, and tables of rows that are laid beside them, partition by partition.

    ``docs`` must give the same rows in the same order whenever it is read, as a scan with filters and columns does; the
    texts of a slice are checked to be those that the table beside it was made from. ``id_col`` is a whole number.
    """

    def __init__(self, docs: DataFrame, path: list[str], id_col: str):
        self.spark, self.path, self.schema, self.id_col = docs.sparkSession, path, docs.schema, id_col
        # One slice at a time goes from process to process, not a hundred as by default.
        self.rdd = docs.rdd.mapPartitionsWithIndex(_sliced(path))._reserialize(BatchedSerializer(CPickleSerializer(), 1))

    def beside(self, table: DataFrame, order: list[str]) -> RDD:
        """(rows of a slice, rows of ``table`` with its part and slice, in ``order``). Every slice must have a row there.
        One zip of two: each further one would need more Python processes in a task."""
        n = self.rdd.getNumPartitions()
        if not n:
            return self.rdd
        sides = table.repartitionById(n, F.col("part")).sortWithinPartitions("slice", *order).rdd.mapPartitions(_gathered)
        more = n - sides.getNumPartitions()  # an empty table may be planned with fewer partitions
        sides = sides.union(sides.context.parallelize([], more)) if more > 0 else sides
        sides = sides._reserialize(BatchedSerializer(CPickleSerializer(), 1))

        def joined(pair: tuple) -> tuple:
            (part, number, rows), (*key, mine) = pair
            if [part, number] != key:
                raise RuntimeError(f"slice {part, number} was read in another order: {key}")
            return rows, mine

        return self.rdd.zip(sides).map(joined)

    def table(self, rows: RDD, schema) -> DataFrame:
        return self.spark.createDataFrame(rows, schema, verifySchema=False)

    def places(self) -> DataFrame:
        """(part, slice, mark, row, id) of every row."""
        return self.table(self.rdd.flatMap(_placed(self.path, self.id_col)), "part int, slice int, mark long, row int, id long")
