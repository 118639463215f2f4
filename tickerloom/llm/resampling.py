"""Importance resampling towards a target: documents whose words and word pairs look like those of the target texts.

Every feature (a word, or two consecutive words with a space between) belongs to the bucket of its CRC-32. The log ratio
of a bucket's shares in the target and in the documents is its gain, a document's weight is the mean gain of its
features, and the documents with the highest sums of weight and seeded Gumbel noise are drawn, which is sampling without
replacement in proportion to the exponential of the weights.

The checksum is linear over the bits: what a byte adds depends on its value and its distance from the end alone, and the
length adds a constant. So the checksums of all features of many texts are two table look-ups and one
``bitwise_xor.reduceat`` over their spans; spans longer than the table are cut into blocks, whose sums are moved on by
as many zero bytes and joined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .storage import shared_folder, stored

BUCKETS = 10_000
SEED = 7
#: Documents with fewer words are not drawn; of the others this share in percent is.
LEAST_WORDS, PERCENT = 20, 25
#: Distances from the end in the table of contributions, and bytes of a block of a longer span.
BLOCK = 64
#: Bytes of text whose features are held at a time.
SLICE = 1 << 18


def _zero_bytes(sums: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums after one more zero byte."""
    return (sums >> np.uint32(8)) ^ table[sums & np.uint32(255)]


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a byte adds at each distance from the end (distance, byte), the constants of the lengths, and what each of a
    sum's four bytes adds after ``BLOCK`` more bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1)).astype(np.uint32)
    added = [table]
    for _ in range(BLOCK - 1):
        added.append(_zero_bytes(added[-1], table))
    moved = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    for _ in range(BLOCK):
        moved = _zero_bytes(moved, table)
    return np.stack(added), np.array([zlib.crc32(bytes(n)) for n in range(BLOCK + 1)], np.uint32), moved


def _linear(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The linear part of the checksum of spans of 1 to ``BLOCK`` bytes."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum()))
    left = np.repeat(first + lengths - 1, lengths) - at  # distance from the end
    place = at + np.repeat(starts - first, lengths)
    return np.bitwise_xor.reduceat(_tables()[0].ravel()[(left << 8) | data[place]], first)


def span_checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of one byte or more."""
    _, constant, moved = _tables()
    out = np.zeros(len(starts), np.uint32)
    short = lengths <= BLOCK
    if short.all():
        return _linear(data, starts, lengths) ^ constant[lengths]
    out[short] = _linear(data, starts[short], lengths[short]) ^ constant[lengths[short]]
    long = np.flatnonzero(~short)
    # The first block is the shorter one, so that all others are moved on by the same distance.
    blocks = -(-lengths[long] // BLOCK)
    head = lengths[long] - (blocks - 1) * BLOCK
    order = words.ragged(blocks)
    of = np.repeat(np.arange(len(long)), blocks)
    begin = np.where(order == 0, starts[long][of], starts[long][of] + head[of] + (order - 1) * BLOCK)
    parts = _linear(data, begin, np.where(order == 0, head[of], BLOCK))
    at, sums = np.cumsum(blocks) - blocks, np.zeros(len(long), np.uint32)
    for k in range(int(blocks.max())):
        more = np.flatnonzero(blocks > k)
        s = sums[more]
        sums[more] = moved[0][s & 255] ^ moved[1][(s >> 8) & 255] ^ moved[2][(s >> 16) & 255] ^ moved[3][s >> 24] ^ parts[at[more] + k]
    length_constant = {int(n): zlib.crc32(bytes(int(n))) for n in np.unique(lengths[long])}
    out[long] = sums ^ np.array([length_constant[int(n)] for n in lengths[long]], np.uint32)
    return out


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words after A-Z are lower-cased: digits, a-z and all that are not ASCII; and the lower-cased bytes."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    inside[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    return inside, lower


def text_features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every word, of the pair that every word begins (-1 if none follows in its text), and the number of words
    before each text (one more than texts)."""
    data, offsets = words.text_bytes(texts)
    inside, lower = _letters()
    data = lower[data]
    starts, ends, before = words.word_spans(data, offsets, inside[data])
    lengths = ends - starts
    # The words with one space between; spans of features are places among them.
    place = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int((lengths + 1).sum()), 32, np.uint8)
    at = words.ragged(lengths)
    joined[np.repeat(place, lengths) + at] = data[np.repeat(starts, lengths) + at]
    single = (span_checksums(joined, place, lengths) % np.uint32(buckets)).astype(np.int64)
    pair = np.full(len(starts), -1, np.int64)
    follows = np.ones(len(starts), bool)
    follows[before[1:][before[1:] > 0] - 1] = False
    first = np.flatnonzero(follows)
    if len(first):
        pair[first] = span_checksums(joined, place[first], lengths[first] + 1 + lengths[first + 1]) % np.uint32(buckets)
    return single, pair, before


def _count(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for a, z in words.text_slices(batch.column(0), SLICE):
                single, pair, _ = text_features(batch.column(0).slice(a, z - a), buckets)
                total += np.bincount(single, minlength=buckets) + np.bincount(pair[pair >= 0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return count


def bucket_counts(table: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the features of all texts by bucket; a null text has none."""
    texts = table.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_count(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in thousandths; every document and target text is counted."""
    counts = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    for name, table, column in (("s", docs, text_col), ("t", target, target_col)):
        counts = counts.join(bucket_counts(table, column, buckets).withColumnRenamed("n", name), "bucket", "left")
    counts = counts.fillna(0, ["s", "t"])
    total = counts.select("bucket", "s", "t", *[F.sum(c).over(Window.partitionBy()).alias(f"all_{c}") for c in "st"])
    d = lambda c, n: (F.col(c) + n).cast("double")
    gain = F.floor(1000 * F.ln(d("t", 1) * d("all_s", buckets) / (d("s", 1) * d("all_t", buckets))))
    rows = total.select("bucket", gain.alias("gain")).toArrow()  # one row a bucket
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("gain").to_numpy()
    return out


def _weigh(shared):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = np.append(shared.value, 0)
        for batch in batches:
            texts = batch.column(1)
            for a, z in words.text_slices(texts, SLICE):
                single, pair, before = text_features(texts.slice(a, z - a), len(gains) - 1)
                gain = np.concatenate([[0], np.cumsum(gains[single] + gains[pair])])
                some = np.concatenate([[0], np.cumsum(pair >= 0)])
                n = np.diff(before)
                features = n + np.diff(some[before])
                weight = np.diff(gain[before]) // np.maximum(features, 1)  # floors go down
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, z - a), pa.array(n), pa.array(features), pa.array(weight)],
                    names=[batch.schema.names[0], "_words", "n_features", "weight"],
                )

    return weigh


def resampled(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    buckets: int = BUCKETS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """(id_col, n_features, weight, score, rank) of every row of ``docs``; ``rank`` counts the drawn rows from 1, the
    highest score first, and is null for others.

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred (rounded down) are drawn; of equal scores the
    smaller id comes first, a null id (which counts as an empty text in the noise) last. Null texts and texts without a
    word have no features, weight 0, and are not drawn unless ``least_words`` is 0. Rows that repeat an id share its
    noise and count each. Without target texts all words are judged by how common they are. Other columns are ignored;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bucket_gains(docs, target, text_col, target_col, buckets))
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()
    rows = rows.mapInArrow(_weigh(shared), f"`{id_col}` {kind}, _words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    noise = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.ln(-F.ln((noise + 0.5) / 4294967296.0)))
    rows = stored(rows.withColumn("score", score), shared_folder(spark), "scored")
    able = rows.where(F.col("_words") >= least_words)
    # Scores are whole numbers between the extremes of gain and noise: a row for each that occurs, not for each document.
    steps = able.groupBy("score").agg(F.count("*").alias("_n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0)))
    steps = steps.withColumn("_drawn", F.floor(F.sum("_n").over(Window.partitionBy()) * percent / 100).cast("long"))
    steps = stored(steps.where("_above < _drawn").select("score", "_above", "_drawn"))
    within = Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last())
    drawn = able.join(steps, "score").withColumn("rank", F.col("_above") + F.row_number().over(within))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= F.col("_drawn"), F.col("rank")).cast("long"))
    others = able.join(steps, "score", "left_anti").union(rows.where(F.col("_words") < least_words).select("score", *[c for c in rows.columns if c != "score"]))
    columns = [id_col, "n_features", "weight", "score"]
    return drawn.select(*columns, "rank").union(others.select(*columns, F.lit(None).cast("long").alias("rank")))
