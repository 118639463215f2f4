"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions of documents.

All sources share the total size by their weights. A source can be used at most ``epochs`` times; what it cannot give is
shared out again by weight, which has one solution. A document is repeated as often as its whole source is; the rest of
the target goes to documents in the order of a seeded hash until it is used up, and the last one gives part of its words.
So a document's share follows from its source and its own hash alone, and no text has to move.
"""

from __future__ import annotations

import re

import pyarrow as pa
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .storage import stored

#: Weights of the sources in order, repeated.
WEIGHTS = (5, 2, 1)
SEED = 17
#: More sources than this are an error, as their table is sent to all executors.
MAX_SOURCES = 50_000
#: The hash order is summed in this many parts of each source first.
PARTS_BITS = 12

_SHARES = T.StructType(
    [T.StructField("_source", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("source_size",)]
    + [T.StructField("target", T.DoubleType())]
    + [T.StructField(n, T.LongType()) for n in ("_whole", "_rest", "_hash", "_id", "_size", "_part")]
)


@F.arrow_udf(T.LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """Number of words of each text; null has none."""
    out = [np.zeros(0, np.int64)]
    for a, z in words.text_slices(texts):
        out.append(np.diff(words.word_spans(*words.text_bytes(texts.slice(a, z - a)))[2]))
    return pa.array(np.concatenate(out))


@F.arrow_udf(T.StringType())
def first_words(texts: pa.Array, counts: pa.Array) -> pa.Array:
    """The text up to its count-th word; null stays null."""
    out = []
    for text, n in zip(texts.to_pylist(), counts.to_pylist()):
        end = 0
        for _, m in zip(range(n), re.finditer(r"[^\x20\x09-\x0D]+", text or "")):
            end = m.end()
        out.append(text if text is None else text[:end])
    return pa.array(out, pa.string())


def water_fill(sizes: list[int], weights: list[int], epochs: int) -> list[float]:
    """Targets that share the sum of ``sizes`` by ``weights``, none above ``epochs`` times its size."""
    caps, targets = [epochs * s for s in sizes], [0.0] * len(sizes)
    left, weight = sum(sizes), sum(weights)
    order = sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i))
    for k, i in enumerate(order):
        if left * weights[i] <= caps[i] * weight:  # from here on nobody reaches the cap
            for j in order[k:]:
                targets[j] = weights[j] * float(left) / weight
            break
        targets[i], left, weight = float(caps[i]), left - caps[i], weight - weights[i]
    return targets


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def _draws(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """The columns of ``docs`` with its size, source key, seeded hash (32 bits) and id for ordering."""
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return docs.withColumns(
        {
            "_size_of": F.coalesce(word_count(F.col(text_col).cast("string")), F.lit(0)),
            "_source": _key(source_col),
            "_hash_of": F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"),
            "_id_of": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))),
        }
    )


def source_shares(narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3) -> DataFrame:
    """One row a source from the rows of ``_draws``: its size, target, whole repetitions and where the rest ends."""
    spark = narrow.sparkSession
    totals = narrow.groupBy("_source").agg(F.sum("_size_of").alias("s")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = sorted(((r[0], r[1]) for r in totals), key=lambda r: (r[0] == "n", r[0]))
    targets = water_fill([s for _, s in totals], [weights[i % len(weights)] for i in range(len(totals))], epochs)
    plan = {}
    for (key, size), target in zip(totals, targets):
        whole, rest = divmod(round(target), size) if size else (0, 0)
        plan[key] = [key, size, target, whole, rest, None, None, None, None]
    wanted = spark.createDataFrame([(k, p[4]) for k, p in plan.items() if p[4]], "_source string, _rest long")
    parts = narrow.withColumn("_bin", F.shiftright("_hash_of", 32 - PARTS_BITS)).join(F.broadcast(wanted), "_source")
    bins = parts.groupBy("_source", "_rest", "_bin").agg(F.sum("_size_of").alias("s"))
    from pyspark.sql import Window

    along = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("_to", F.sum("s").over(along)).withColumn("_from", F.col("_to") - F.col("s"))
    last = bins.where("_from < _rest and _rest <= _to").select("_source", "_bin", "_from")
    rows = parts.join(last, ["_source", "_bin"]).groupBy("_source", "_rest", "_from", "_hash_of", "_id_of", "_size_of").agg(F.count("*").alias("m"))
    along = Window.partitionBy("_source").orderBy("_hash_of", "_id_of", "_size_of").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_to", F.col("_from") + F.sum(F.col("_size_of") * F.col("m")).over(along))
    rows = rows.withColumn("_left", F.col("_rest") - F.col("_to") + F.col("_size_of") * F.col("m"))
    for r in rows.where("_left > 0 and _rest <= _to").collect():
        plan[r["_source"]][5:] = [r["_hash_of"], r["_id_of"], r["_size_of"], r["_left"] // r["m"]]
    return spark.createDataFrame([tuple(p) for p in plan.values()], _SHARES)


def _taken() -> Column:
    """Words that the mix takes of a row that has its source's share."""
    mine, end = F.struct("_hash_of", "_id_of", "_size_of"), F.struct("_hash", "_id", "_size")
    extra = F.when(F.col("_hash").isNull(), 0).when(mine < end, F.col("_size_of")).when(mine == end, F.col("_part")).otherwise(0)
    return F.col("_whole") * F.col("_size_of") + extra


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = 3, seed: int = SEED) -> DataFrame:
    """(id_col, size, source_size, target, taken) of every row.

    Null texts have no words, null sources are one source (the last), other columns are ignored; a source without
    words has target 0. Rows alike in id and size are drawn alike. An empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"), F.col(source_col).alias("_src"))
    narrow = stored(_draws(narrow, "_doc", "_text", "_src", seed).drop("_text", "_src"))
    out = narrow.join(F.broadcast(source_shares(narrow, weights, epochs)), "_source")
    return out.select(F.col("_doc").alias(id_col), F.col("_size_of").alias("size"), "source_size", "target", _taken().alias("taken"))


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = 3, seed: int = SEED) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: a document once for every repetition, not at all if it has
    none; the one document of a source that is taken in part has its first words. Documents without words stay once.
    ``n_chars`` follows the text if there is such a column."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    drawn = packed.select("_row", F.col(f"_row.`{id_col}`").alias("_doc"), F.col(f"_row.`{text_col}`").alias("_text"), F.col(f"_row.`{source_col}`").alias("_src"))
    drawn = _draws(drawn, "_doc", "_text", "_src", seed)
    narrow = stored(drawn.select("_source", "_hash_of", "_id_of", "_size_of"))
    out = drawn.join(F.broadcast(source_shares(narrow, weights, epochs)), "_source").withColumn("_taken", _taken())
    size, left = F.col("_size_of"), F.col("_taken") % F.col("_size_of")
    times = F.when(size == 0, F.array(F.lit(0))).otherwise(F.concat(F.array_repeat(size, F.floor(F.col("_taken") / size).cast("int")), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<bigint>"))))
    out = out.select("_row", "_text", "_size_of", F.explode(times).alias("_words"))
    whole = out.where("_words = _size_of").select("_row.*")
    part = out.where("_words < _size_of").withColumn("_text", first_words("_text", "_words"))
    cut = {text_col: F.col("_text"), "n_chars": F.length("_text").cast("long")}
    part = part.select(*[cut[c].alias(c) if c in cut else F.col(f"_row.`{c}`") for c in names])
    return whole.union(part)
