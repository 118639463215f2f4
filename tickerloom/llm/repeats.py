"""Removal of repeated passages: every byte that a string of 400 bytes covers which starts anywhere else, too.

Suffixes are sorted into buckets that are refined by bucket identifiers of later offsets. An identifier is a number that
follows from the bytes alone, so all tasks agree on it without asking: that of a short string is a polynomial of its
bytes, and that of a string twice as long is made of the identifiers of its halves, the second of which starts at a later
offset. Each length reuses the identifiers of the one before, up to 400.

1. **Initial buckets.** Sorting all suffixes is not needed: of the 301 strings of 100 bytes in a string of 400, the one
   with the smallest identifier is its *anchor*. Equal strings have equal anchors at equal places, so a string can repeat
   only if its anchor's bucket has two members. Anchors lie about 150 bytes apart; only they are shuffled.
2. **First refinement.** The strings of 400 bytes with one anchor are a *run*. It is named by the identifiers of its first
   and last string, which cover all of it. A run that is there twice is repeated whole; a bucket of one is done.
3. **Further refinements.** What is left are buckets with a run that is there once, as at both ends of a repeated
   passage. Such runs, and one of each repeated run of the bucket, are cut at fixed distances from the anchor into blocks
   of 64, then 8 strings, then single ones. The bytes that all strings of a whole block have in common (337, 393, 400)
   refine the bucket. At each size the same steps settle blocks that are there twice and buckets of one, and only the
   rest is cut again.

Counts are partial sums before every shuffle and the joins may be split, so a passage that a third of all texts hold does
not meet in one task. Long texts are worked on in pieces of a mebibyte that overlap by one string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .storage import shared_folder, stored

#: Bytes of the strings that may not repeat.
LENGTH = 400
#: An anchor has a quarter of them.
QUARTER = 4
#: Longest string whose identifier is a polynomial of its bytes.
BASE = 32
#: Strings of a block in the refinements after the first; the last must be 1.
BLOCKS = (64, 8, 1)
#: Bytes of a text that are worked on at a time, and bits that hold a place among them.
PIECE, PLACE_BITS = 1 << 20, 21


def identifiers(data: np.ndarray, length: int, also: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit identifiers of the strings of ``also`` and of ``length`` bytes at every place of ``data`` that has as many."""
    halves = [length]
    while halves[-1] > BASE:
        halves.append(-(-halves[-1] // 2))
    power, inverse = words._powers(1 << max(10, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(words._tables()[2][data] * power[: len(data)], out=sums[1:])

    def polynomial(n: int) -> np.ndarray:
        count = max(0, len(data) - n + 1)
        return words.mix((sums[n:] - sums[: len(sums) - n])[:count] * inverse[:count])

    n = halves.pop()
    now, have = polynomial(n), polynomial(also) if also < n else None
    while halves:
        longer = halves.pop()
        if have is None and also < longer:
            have = now if also == n else _joined(now, n, also, len(data))
        now, n = _joined(now, n, longer, len(data)), longer
    return now if have is None else have, now


def _joined(ids: np.ndarray, n: int, longer: int, size: int) -> np.ndarray:
    """Identifiers of longer strings from those of their first and last ``n`` bytes."""
    count, later = max(0, size - longer + 1), longer - n
    return words.mix(ids[:count] * np.uint64(0x9E3779B97F4A7C15) + ids[later : later + count] + np.uint64(longer))


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours, from running minima to both ends of blocks of that width."""
    count = len(keys) - width + 1
    padded = np.concatenate([keys, np.full(-len(keys) % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


_RUNS = np.dtype([("text", "<i8"), ("start", "<i8"), ("q", "<u8"), ("name", "<u8"), ("n", "<i4"), ("at", "<i4"), ("stride", "<i4"), ("reps", "<i4")])


def _name(first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of strings that follow each other, no more than their length: the first and the last cover all bytes."""
    return words.mix(first * np.uint64(3) + words.mix(last + np.uint64(1)) + n.astype(np.uint64))


def _piece_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """The runs of texts on end: text, first start, bucket, name, number of strings, and the anchor's distance from the
    first start. ``reps`` runs alike follow each other at a distance of ``stride``, as in periodic texts."""
    gram = max(1, length // QUARTER)
    starts = max(0, len(data) - length + 1)
    if not starts:
        return np.zeros(0, _RUNS)
    short, ids = identifiers(data, length, gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    places = np.arange(len(short), dtype=np.uint64)
    anchor = (_smallest((short & ~low) | places, length - gram + 1) & low).astype(np.int64)[:starts]
    end = np.repeat(offsets[1:], np.diff(offsets))[:starts]
    at = np.flatnonzero(np.arange(starts) + length <= end)
    if not len(at):
        return np.zeros(0, _RUNS)
    anchor, end = anchor[at], end[at]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (end[1:] != end[:-1])]))
    last = np.append(first[1:], len(at)) - 1
    out = np.zeros(len(first), _RUNS)
    out["start"], out["n"] = at[first], at[last] - at[first] + 1
    out["text"] = np.searchsorted(offsets, out["start"], side="right") - 1
    out["q"] = short[anchor[first]]
    out["at"] = anchor[first] - at[first]
    out["name"] = _name(ids[at[first]], ids[at[last]], out["n"])
    # Runs alike at equal distances become one row.
    same = (out["q"][1:] == out["q"][:-1]) & (out["name"][1:] == out["name"][:-1]) & (out["text"][1:] == out["text"][:-1])
    step = np.diff(out["start"])
    go = same.copy()
    go[1:] &= ~same[:-1] | (step[1:] == step[:-1])
    head = np.flatnonzero(np.concatenate([[True], ~go]))
    out["stride"][:-1] = np.where(go, step, 0)
    out["reps"][head] = np.diff(np.append(head, len(out)))
    out = out[head]
    out["start"] -= offsets[out["text"]]
    return out


def text_runs(texts: pa.Array, length: int) -> Iterator[np.ndarray]:
    """The runs of all texts, ``text`` counts from the first one."""
    for a, z in words.text_slices(texts, PIECE):
        data, offsets = words.text_bytes(texts.slice(a, z - a))
        if len(data) <= PIECE + length:
            runs = _piece_runs(data, offsets, length)
            runs["text"] += a
            yield runs
            continue
        for at in range(0, max(1, len(data) - length + 1), PIECE):  # one text
            part = data[at : at + PIECE + length - 1]
            runs = _piece_runs(part, np.array([0, len(part)]), length)
            runs["text"] += a
            runs["start"] += at
            yield runs


_KEYS = "a long, b long"
_RUN_COLUMNS = ["start", "q", "name", "n", "at", "stride", "reps"]


def _emit_runs(length: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in "ab")
            for runs in text_runs(batch.column("text"), length):
                who = runs["text"]
                columns = [pa.array(np.ascontiguousarray(runs[c]).view(np.int64) if c in ("q", "name") else runs[c]) for c in _RUN_COLUMNS]
                yield pa.RecordBatch.from_arrays([pa.array(a[who]), pa.array(b[who]), *columns], names=["a", "b", *_RUN_COLUMNS])

    return emit


def _refined(rows: DataFrame, folder: str, turn: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose name is in their bucket twice or more, and those to cut again: the rows that are there once in a bucket
    of more (``open``), and one of each other name in such a bucket for them to be held against (not ``open``)."""
    counts = rows.groupBy("q").agg(F.sum("reps").alias("total")).where("total > 1").select("q")
    rows = stored(rows.join(counts, "q", "left_semi"), folder, f"shared-{turn}")
    kinds = rows.groupBy("q", "name").agg(F.sum("reps").alias("count"), F.max("open").alias("asks"))
    unsure = kinds.where("count = 1 and asks").select("q").distinct().withColumn("unsure", F.lit(True))
    kinds = stored(kinds.join(unsure, "q", "left").where("count > 1 or unsure").select("q", "name", "count", F.coalesce("unsure", F.lit(False)).alias("unsure")), folder, f"kinds-{turn}")
    found = stored(rows.join(kinds, ["q", "name"]), folder, f"found-{turn}")
    asked = found.where("open and count = 1")
    others = found.where("unsure and not (open and count = 1)").dropDuplicates(["q", "name"]).withColumn("open", F.lit(False))
    return found.where("open and count > 1"), asked.union(others).drop("count", "unsure")


def _cut(length: int):
    """The bytes of each run."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                data, runs = (text.as_py() or "").encode("utf-8", "surrogatepass"), batch.column("runs")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("a")[i].as_py()] * len(runs), pa.int64()),
                        pa.array([batch.column("b")[i].as_py()] * len(runs), pa.int64()),
                        *(pa.array([r[c] for r in runs], t) for c, t in (("start", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("q", pa.int64()), ("open", pa.bool_()))),
                        pa.array([data[r["start"] : r["start"] + r["n"] + length - 1] for r in runs], pa.binary()),
                    ],
                    names=["a", "b", "start", "at", "n", "q", "open", "string"],
                )

    return cut


_BLOCK = "run long, q long, name long, open boolean, lo int, n int"


def _blocks(length: int, size: int):
    """The blocks of ``size`` strings that the pieces of each run are cut into."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = batch.column("string").to_pylist()
            for a, z in words.text_slices(batch.column("string"), PIECE):
                data = np.frombuffer(b"".join(strings[a:z]), np.uint8)
                offsets = np.cumsum([0, *map(len, strings[a:z])])
                core, ids = identifiers(data, length, length - size + 1)
                pieces = batch.column("pieces").slice(a, z - a)
                owner = np.repeat(np.arange(z - a), np.diff(pieces.offsets.to_numpy()))
                flat = pieces.flatten()
                q, lo, n = (flat.field(c).to_numpy().astype(np.int64) for c in ("q", "lo", "n"))
                opened = flat.field("open").to_numpy(zero_copy_only=False)
                piece, at = np.repeat(np.arange(len(n)), n), words.ragged(n)
                place = lo[piece] + at
                anchor = batch.column("at").to_numpy().astype(np.int64)[a:z][owner[piece]]
                block = (anchor - place) // size
                first = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (block[1:] != block[:-1])]))
                last = np.append(first[1:], len(piece)) - 1
                of, begin = piece[first], offsets[owner[piece]] + place
                count = last - first + 1
                # The last start of the whole block; the strings of the run are only a part of it at the run's ends.
                inner = core[offsets[owner[of]] + anchor[first] - block[first] * size]
                bucket = words.mix(q[of].view(np.uint64) * np.uint64(5) + inner * np.uint64(9) + block[first].astype(np.uint64))
                name = _name(ids[begin[first]], ids[begin[last]], count)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(batch.column("run").to_numpy()[a:z][owner[of]]),
                        pa.array(bucket.view(np.int64)),
                        pa.array(name.view(np.int64)),
                        pa.array(opened[of]),
                        pa.array(place[first].astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                    ],
                    names=["run", "q", "name", "open", "lo", "n"],
                )

    return blocks


def _named(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``_text`` and its 128-bit name in ``_a`` and ``_b``; null is as the empty text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn("_text", text).withColumn("_a", F.xxhash64("_text")).withColumn("_b", F.xxhash64(F.lit(7), "_text"))


def repeated_places(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(a, b, start, n, stride, reps), distinct: where strings of ``length`` bytes start in the text named (a, b) that
    start anywhere else, too: at n places from ``start``, and so ``reps`` times at a distance of ``stride``."""
    if length < 4:
        raise ValueError("strings have four bytes at least")
    folder = shared_folder(docs.sparkSession)
    texts = _named(docs, text_col).select(F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("_text").alias("text"))
    types = "start long, q long, name long, n int, at int, stride int, reps int"
    runs = stored(texts.mapInArrow(_emit_runs(length), f"{_KEYS}, {types}"), folder, "runs").withColumn("open", F.lit(True))
    found, left = _refined(runs, folder, 0)
    places = [found.select("a", "b", "start", "n", "stride", "reps")]
    lists = left.groupBy("a", "b").agg(F.collect_list(F.struct("start", "at", "n", "q", "open")).alias("runs"))
    each = texts.groupBy("a", "b").agg(F.first("text").alias("text"))  # of equal texts one
    strings = lists.join(each, ["a", "b"]).select("a", "b", "text", "runs")
    strings = strings.mapInArrow(_cut(length), f"{_KEYS}, start long, at int, n int, q long, open boolean, string binary")
    strings = stored(strings.withColumn("run", F.monotonically_increasing_id()), folder, "strings")
    pieces = strings.select("run", F.array(F.struct("q", "open", F.lit(0).alias("lo"), "n")).alias("pieces"))
    for turn, size in enumerate((min(s, length - max(1, length // QUARTER) + 1) for s in BLOCKS), 1):
        rows = strings.select("run", "at", "string").join(pieces, "run").mapInArrow(_blocks(length, size), _BLOCK)
        found, left = _refined(rows.withColumn("reps", F.lit(1)), folder, turn)
        found = found.join(strings.select("run", "a", "b", "start"), "run")
        places.append(found.select("a", "b", (F.col("start") + F.col("lo")).alias("start"), "n", F.lit(0).alias("stride"), F.lit(1).alias("reps")))
        pieces = left.groupBy("run").agg(F.collect_list(F.struct("q", "open", "lo", "n")).alias("pieces"))
    out = places[0]
    for more in places[1:]:
        out = out.union(more)
    return out.distinct()


_KEPT = "kept binary, spans array<struct<start:bigint,stop:bigint>>"


def _remove(length: int, kept: list[str]):
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, spans = [], []
            for text, places in zip(batch.column("_text"), batch.column("_places")):
                data = text.as_py().encode("utf-8", "surrogatepass")
                if not places.is_valid:
                    out.append(data), spans.append([])
                    continue
                start, n, stride, reps = (places.values.field(c).to_numpy().astype(np.int64) for c in ("start", "n", "stride", "reps"))
                start = np.repeat(start, reps) + words.ragged(reps) * np.repeat(stride, reps)
                change = np.zeros(len(data) + 1, np.int32)
                np.add.at(change, start, 1)
                np.add.at(change, start + np.repeat(n, reps) + length - 1, -1)
                edge = np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=0)
                begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(begin, stop)])
                out.append(b"".join(data[x:y] for x, y in zip([0, *stop.tolist()], [*begin.tolist(), len(data)])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.large_binary()), pa.array(spans, span)], names=[*kept, "kept", "spans"])

    return remove


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id_col, n_bytes, kept, spans) of every row: the UTF-8 bytes that are left of its text, and the runs that went.

    A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else in the table, in the same text
    or another; strings do not reach over the end of a text and are judged on the whole input. So all copies of a long
    text go, the first one too. A text that is shorter than ``length`` stays. Null is as the empty text; rows may repeat
    an id or have none; other columns are ignored; an empty table gives no rows. Cuts may fall inside a character, so
    ``kept`` is binary.

    Strings are told apart by 64-bit identifiers among those whose anchors have equal 64-bit identifiers, texts by
    128-bit names.
    """
    rows = _named(docs.select(F.col(id_col), F.col(text_col).alias("text")), "text")
    places = repeated_places(docs, text_col, length).groupBy(F.col("a").alias("_a"), F.col("b").alias("_b"))
    places = places.agg(F.collect_list(F.struct("start", "n", "stride", "reps")).alias("_places"))
    rows = rows.join(places, ["_a", "_b"], "left").select(id_col, "_text", "_places")
    kind = rows.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(_remove(length, [id_col]), f"`{id_col}` {kind}, {_KEPT}")
    removed: Column = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return out.select(id_col, (F.length("kept").cast("long") + removed).alias("n_bytes"), "kept", "spans")


def repeat_digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) of the rows of ``without_repeats``."""
    return rows.select(
        id_col,
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
