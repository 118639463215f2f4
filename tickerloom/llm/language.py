"""Language of a text: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .characters import code_points, has_letter

#: Hash buckets of the n-grams (a power of two), and the longest n-gram.
BUCKETS = 1 << 16
LONGEST = 3
#: Pseudo-count of every bucket.
SMOOTHING = 0.5
#: More languages than this are an error, as the matrix of languages and buckets is sent to all executors.
MAX_LANGUAGES = 1_000
UNKNOWN = "und"


def _grams(codes: np.ndarray, buckets: int, longest: int) -> Iterator[np.ndarray]:
    """Bucket of the n-gram that starts at each code point, for each n.

    The zero between two texts may begin or end an n-gram, as the edge of a text; n-grams with a zero inside, zeros alone
    and those beyond the end get the number ``buckets``.
    """
    wide, gap = codes.astype(np.uint64), codes == 0
    key, inside = np.zeros(len(codes), np.uint64), np.zeros(len(codes), bool)
    for n in range(1, longest + 1):
        m = max(0, len(codes) - n + 1)
        key[:m] = key[:m] * np.uint64(0x100000001B3) + wide[n - 1 :] + np.uint64(n)
        if n > 2:
            inside[:m] |= gap[n - 2 : n - 2 + m]
        bucket = (words.mix(key) & np.uint64(buckets - 1)).astype(np.int64)
        bucket[:m][inside[:m] if n > 2 else gap[:m] & gap[n - 1 :]] = buckets
        bucket[m:] = buckets
        yield bucket


def _count(languages: list[str], buckets: int, longest: int):
    """Counts of each language and bucket in one task's texts."""
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), buckets + 1), np.int64)
        for batch in batches:
            langs, texts = batch.column("lang"), batch.column("text")
            kinds = np.array([number[x] for x in langs.to_pylist()], np.int64)
            for a, z in words.text_slices(texts, 1 << 20):
                for k in np.unique(kinds[a:z]):
                    mine = (np.flatnonzero(kinds[a:z] == k) + a).tolist()
                    codes, _ = code_points(texts.take(pa.array(mine)).to_pylist())
                    for bucket in _grams(codes, buckets, longest):
                        total[k] += np.bincount(bucket, minlength=buckets + 1)
        for k, lang in enumerate(languages):
            at = np.flatnonzero(total[k, :buckets])
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[k][at])], names=["lang", "bucket", "n"]
                )

    return count


def language_model(train: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[list[str], np.ndarray]:
    """Learned languages in order, and a matrix of ``buckets`` rows: the log probability of each bucket in each.

    Rows with a null text or language teach nothing; texts in which no n-gram is found neither.
    """
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = rows.mapInArrow(_count(languages, buckets, longest), "lang string, bucket int, n long") if languages else None
    matrix = np.zeros((len(languages), buckets + 1))
    if counts is not None:
        sums = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most buckets rows a language
        number = {x: i for i, x in enumerate(languages)}
        matrix[[number[x] for x in sums.column("lang").to_pylist()], sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    smooth = matrix[:, :buckets] + SMOOTHING
    matrix[:, :buckets] = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    matrix[:, buckets] = 0
    return languages, np.ascontiguousarray(matrix.T.astype(np.float32))


def _predict(languages: list[str], shared, longest: int):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        buckets = len(matrix) - 1
        for batch in batches:
            texts, names, scores = batch.column("text"), [], []
            for a, z in words.text_slices(texts, 1 << 20):
                part = texts.slice(a, z - a).to_pylist()
                letters = has_letter(part)
                total = np.zeros((len(part), len(languages)))
                if languages:
                    codes, places = code_points(part)
                    for bucket in _grams(codes, buckets, longest):
                        # Rows of a sparse matrix of counts times the matrix, a language at a time.
                        for k in range(len(languages)):
                            total[:, k] += np.add.reduceat(matrix[:, k][bucket].astype(np.float64), places[:-1])
                    best = total.argmax(axis=1)
                    share = 1 / np.exp(np.minimum(total - total.max(axis=1, keepdims=True), 0)).sum(axis=1)
                for i in range(len(part)):
                    known = bool(letters[i]) and bool(languages)
                    names.append(languages[best[i]] if known else UNKNOWN)
                    scores.append(float(share[i]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return predict


def with_language(docs: DataFrame, train: DataFrame, id_cols: list[str], text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``id_cols`` of every row of ``docs`` with its predicted language and the probability of that.

    Languages weigh alike beforehand; of equal ones the first by code point is taken. Null texts and texts without a
    letter, and all if nothing was learned, are ``und`` with score 0. Rows that repeat stay.
    """
    languages, matrix = language_model(train, text_col, lang_col, buckets, longest)
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    rows = docs.select(*id_cols, F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_predict(languages, shared, longest), f"{schema}, lang_pred string, score double")
