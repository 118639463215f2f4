"""Packing documents into sequences: a cutting-stock linear program by column generation over the length histogram.

Every text becomes token ids and an end id, cut into pieces of one sequence's length and a shorter last one. Lengths are
counted in classes of ``STEP`` tokens (rounded up, so a pattern of classes always fits). The linear program finds how
often each pattern of classes is used; a knapsack dynamic program finds the next pattern worth adding. Patterns are used
their rounded-down number of times, the few pieces left over are packed largest first. Then each piece, by its rank in
its class, gets the place that the patterns in order have for that rank. Only the histogram reaches the driver.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import shared_folder, stored

SIZE = 2048
#: Tokens of a length class; there are SIZE / STEP classes at most.
STEP = 8
#: The end id that follows every document, and the vocabulary's one special token.
END = 1
SPECIAL = {"<|endoftext|>": 50256}
#: The program stops when its value is proven to be within this share of the best.
GAP = 1e-4
#: Parts of a class, for ranking its pieces.
PARTS = 1024


def public_vocabulary() -> tuple[str, str]:
    """The files of the 50k byte-level vocabulary: one for the tokenizers library, and its ranks."""
    from public_tokenizers import path

    return path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")


@lru_cache(1)
def _encoder(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=SPECIAL)


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def _pieces(ranks: str, pattern: str, size: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks, pattern)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encoder.encode_to_numpy(text.as_py() or "", allowed_special="all").astype("<u4"), np.array([END], "<u4"))
                for start in range(0, len(ids), size):
                    part = ids[start : start + size]
                    out.append((doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _PIECE)], schema=_PIECE)

    return pieces


def document_pieces(docs: DataFrame, id_col: str, text_col: str, ranks: str | None = None, size: int = SIZE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of the pieces of every text; null is the empty text."""
    from public_tokenizers import PATTERN

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(ranks or public_vocabulary()[1], PATTERN, size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def _best_pattern(values: np.ndarray, widths: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern that fits into ``room`` (unbounded knapsack over exact fills)."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        fits = int(np.searchsorted(widths, w, side="right"))
        if fits:
            got = best[w - widths[:fits]] + values[:fits]
            k = int(got.argmax())
            if got[k] > best[w]:
                best[w], last[w] = got[k], k
    pattern, w = np.zeros(len(widths)), room
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            pattern[last[w]] += 1
            w -= widths[last[w]]
    return best[room], pattern


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix times vector, or vector times matrix, by plain loops (see ``solved``)."""
    return np.einsum("ij,j->i", a, b) if a.ndim == 2 else np.einsum("i,ij->j", a, b)


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with a x = b for a vector or matrix b, by elimination in vector steps.

    The driver has started the JVM as a child process by now, after which the threads of a linear algebra library may
    wait for ever; a program of a few hundred classes needs none of them.
    """
    m, both = len(a), np.column_stack([a, b]).astype(float)
    for k in range(m):
        p = k + int(np.abs(both[k:, k]).argmax())
        if not both[p, k]:
            raise ValueError("the matrix is singular")
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        rest = np.arange(m) != k
        both[rest, k:] -= both[rest, k, None] * both[k, k:]
    return both[:, m] if np.ndim(b) == 1 else both[:, m:]


def cutting_stock(demand: dict[int, int], room: int, gap: float = GAP, rounds: int = 20_000) -> list[tuple[dict[int, int], int]]:
    """Patterns {width: places} and how often each is used: the linear program's solution, rounded down.

    A piece may take a wider place; as columns of their own these exchanges keep the prices in order, which is what makes
    the column generation settle. It stops when its value is within ``gap`` of the proven bound.
    """
    widths = np.array(sorted(w for w, n in demand.items() if n > 0), np.int64)
    m = len(widths)
    if not m:
        return []
    exact = np.array([demand[int(w)] for w in widths], float)
    # A trifle more of each width, never alike, so that no step of the program stands still.
    need = exact + 1e-6 * np.random.default_rng(m).uniform(1, 2, m)
    columns, cost = np.diag((room // widths).astype(float)), np.ones(m)
    inverse = np.diag(1 / (room // widths))
    bound, steady = 0.0, widths / room  # the best bound yet, and its prices
    for turn in range(rounds):
        if turn % 64 == 63:
            inverse = solved(columns, np.eye(m))
        use, prices = _times(inverse, need), _times(cost, inverse)
        steps = np.diff(prices, prepend=0)
        k = int(steps.argmin())
        if steps[k] < -1e-9:  # a place of this width is worth less than a narrower one: let it be exchanged
            entering, price = np.zeros(m), 0.0
            entering[k] = -1
            if k:
                entering[k - 1] = 1
        else:
            for weight in (0.8, 0.0):  # prices half-way to the steady ones first, which find better patterns
                asked = weight * steady + (1 - weight) * prices
                value, entering = _best_pattern(asked, widths, room)
                if (asked * need).sum() / max(value, 1) > bound:
                    bound, steady = (asked * need).sum() / max(value, 1), asked / max(value, 1)
                if (entering * prices).sum() > 1 + 1e-9:
                    break
            price = 1.0
            if (cost * use).sum() <= bound * (1 + gap) or (entering * prices).sum() <= 1 + 1e-9:
                break
        change = _times(inverse, entering)
        able = np.flatnonzero(change > 1e-9)
        out = able[int((np.maximum(use[able], 0) / change[able]).argmin())]
        columns[:, out], cost[out] = entering, price
        inverse[out] /= change[out]
        others = np.arange(m) != out
        inverse[others] -= change[others, None] * inverse[out]
    use = np.floor(solved(columns, exact) + 1e-7)
    return [
        ({int(widths[i]): int(columns[i, k]) for i in np.flatnonzero(columns[:, k])}, int(use[k]))
        for k in np.flatnonzero((use > 0) & (cost > 0))
    ]


def assigned_places(demand: dict[int, int], room: int) -> dict[int, np.ndarray]:
    """For each width, rows (first rank, first sequence, place in the sequence) by rank: the patterns' places go to the
    widest pieces first; pieces without a place are packed largest first, alike sequences at once."""
    left, base, open_, out = dict(demand), 0, [], {w: [] for w in demand}
    plan = cutting_stock(demand, room)
    free: dict[int, list[list[int]]] = {}
    for pattern, times in plan:
        place = 0
        for width in sorted(pattern, reverse=True):
            for _ in range(pattern[width]):
                free.setdefault(width, []).append([base, times, place])
                place += 1
        base += times

    def take(width: int, first: int, times: int, place: int) -> None:
        out[width].append((demand[width] - left[width], first, place))
        left[width] -= times

    for width in sorted({*demand, *free}, reverse=True):
        open_ += free.get(width, [])
        while open_ and left.get(width):
            first, times, place = open_.pop()
            now = min(times, left[width])
            take(width, first, now, place)
            if now < times:
                open_.append([first + now, times - now, place])
    rest = sorted((w for w, n in left.items() if n), reverse=True)
    while rest:
        space, pattern = room, []
        for w in rest:
            n = min(left[w], space // w)
            if n:
                pattern.append((w, n))
                space -= n * w
        times, place = min(left[w] // n for w, n in pattern), 0
        for w, n in pattern:
            for _ in range(n):
                take(w, base, times, place)
                place += 1
        base += times
        rest = [w for w in rest if left[w]]
    return {w: np.array(rows, np.int64) for w, rows in out.items() if rows}


def _placed(places: dict[int, np.ndarray]):
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = (batch.column(c).to_numpy() for c in ("_class", "_rank"))
            sequence, place = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for k in np.unique(kind):
                mine, table = kind == k, places[int(k)]
                row = table[np.searchsorted(table[:, 0], rank[mine], side="right") - 1]
                sequence[mine], place[mine] = row[:, 1] + rank[mine] - row[:, 0], row[:, 2]
            cols = [batch.column(c) for c in _PIECE.names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(place)], names=[*_PIECE.names, "sequence_id", "_place"])

    return placed


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, size: int = SIZE, step: int = STEP) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    ``ids_crc32`` is over the piece's ids as little-endian unsigned 32-bit numbers. A null text is the empty one: a
    document of the end id alone. Rows that repeat a document are packed as often as they come; other columns are
    ignored; an empty table gives no rows. ``ranks`` names the vocabulary's file.
    """
    if size % step:
        raise ValueError("the sequence's length must be a multiple of the step")
    folder = shared_folder(docs.sparkSession)
    pieces = stored(document_pieces(docs, id_col, text_col, ranks, size), folder, "pieces")
    pieces = pieces.withColumn("_class", F.ceil(F.col("length") / step).cast("int"))
    pieces = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(PARTS)).cast("int"))
    parts = stored(pieces.groupBy("_class", "_part").agg(F.count("*").alias("n")), folder, "parts")
    demand = {r[0]: r[1] for r in parts.groupBy("_class").agg(F.sum("n")).collect()}  # size / step classes at most
    places = assigned_places(demand, size // step)
    before = Window.partitionBy("_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_class", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    along = Window.partitionBy("_class", "_part").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.join(parts, ["_class", "_part"]).withColumn("_rank", F.col("_before") + F.row_number().over(along) - 1)
    ranked = ranked.select(*_PIECE.names, "_class", "_rank")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, _place long"
    out = ranked.mapInArrow(_placed(places), schema)
    before = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return out.drop("_place").withColumnRenamed("doc_id", id_col)
