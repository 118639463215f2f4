"""Jaccard join on word shingles: rare-first prefixes, then length, position and suffix filters, then one check a pair.

1. Every text becomes its set of 5-word shingles (64-bit hashes). Texts with equal sets are one *set* from here on.
2. The hashes are dealt to buckets, packed, and each bucket counts in how many sets a shingle is. Frequent ones are
   known as such in the map tasks already and mostly do not go there.
3. Only shingles in two sets or more go back to their sets. Ordered from rare to frequent, a set's prefix is all that a
   similar set must share a shingle with; shingles of one set come first, so most prefixes hold no shared one at all.
4. Sets meet on prefix shingles. First each meets only the most central set of a bucket (few rare shingles before the
   one they share); what that links is one component, in which nothing more has to be compared. Then all pairs of
   different components that pass the filters are checked. Each pair is checked once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .components import connected_components
from .storage import give_back, giving_back, shared_folder, shuffle_partitions, stored

#: A shingle in so many sets is common; more frequent ones are ordered by hash alone.
MANY = 64
#: Shingles that a map task holds before it sends them to the buckets.
HELD = 1_000_000
#: Bytes of a shingle's hash that are sent, after the bits that name its bucket.
KEY = 6
#: Bytes of text for each bucket of shingles: some 25 MB of packed shingles. There are as many buckets of sets, and what one
#: sends to another is one row. A bucket of either kind is worked on in 2 ** FINER pieces.
BUCKET_BYTES = 16 << 20
FINER = 2
#: Parts that the suffix filter cuts a set into, a byte of a long each; it passes over sets with more than 255 in one.
PARTS = 8
#: While more pairs than this would meet on a shingle on average, sets are first compared with one more central set.
PAIRS_A_TOKEN = 16
CENTRES = 3


def _pack(owner: np.ndarray, key: np.ndarray, *columns: np.ndarray) -> bytes:
    """Items sorted by their set, as bytes: how many runs and items, each run's set and number of items, then the items'
    keys and further columns. A set with more than 255 items has several runs, so a number takes one byte."""
    first, n = _runs(owner)
    more = -(-n // 255)
    at = words.ragged(more)
    first, n = np.repeat(first, more) + 255 * at, np.minimum(np.repeat(n, more) - 255 * at, 255)
    head = np.array([len(first), len(key)], np.int64).tobytes()
    low = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY]
    parts = [owner[first].tobytes(), n.astype(np.uint8).tobytes(), low.tobytes()]
    return head + b"".join(parts) + b"".join(c.tobytes() for c in columns)


def _unpack(blob: bytes, extra: type | None = None):
    """Owner, key and, if asked, one more column of each item."""
    m, n = np.frombuffer(blob, np.int64, 2)
    owners, counts = np.frombuffer(blob, np.uint64, m, 16), np.frombuffer(blob, np.uint8, m, 16 + 8 * m)
    at = 16 + 9 * m
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :KEY] = np.frombuffer(blob, np.uint8, n * KEY, at).reshape(-1, KEY)
    rest = np.frombuffer(blob, extra, n, at + n * KEY) if extra else None
    return np.repeat(owners, counts), wide.view("<u8").ravel().astype(np.uint64), rest


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values of sorted ``x`` starts, and its length."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(x)))


def _split(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (the first bits) and the next 8 * KEY bits of a hash."""
    bits = np.uint64(bits)
    return x >> (np.uint64(64) - bits), (x << bits) >> np.uint64(64 - 8 * KEY)


_DEALT = pa.schema([("bucket", pa.int32()), ("home", pa.int32()), *[(n, pa.binary()) for n in ("items", "common", "sizes", "rows")]])
_ROW = np.dtype([("id", "<i8"), ("known", "?"), ("set", "<u8"), ("n", "<i4")])
_COMMON = np.dtype([("set", "<u8"), ("key", "<u8")])
_SIZE = np.dtype([("set", "<u8"), ("n", "<u4")])


class _Dealer:
    """Packs the texts of one task: one output row a bucket of shingles and one a bucket of sets for every ``HELD`` shingles.

    A shingle that ``MANY`` sets of a task hold is common whatever the other tasks have. Its first sets still go to its
    bucket, so that the bucket knows; all others go straight to the buckets of their sets. So no bucket gets more than a
    few items of a shingle from a task, however many texts hold it. A set's size goes to its bucket once, not with its
    items. Rows go to the buckets in turn.
    """

    def __init__(self, bits: int, size: int):
        self.bits, self.size = bits, size
        self.common, self.dealt = np.zeros(0, np.uint64), 0
        self.clear()

    def clear(self) -> None:
        self.sets, self.keys, self.rows, self.held = [], [], [], 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        key, at = words.shingle_sets(texts, self.size)
        n = np.diff(at)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(key + np.uint64(77)))])
        name = words.mix((total[at[1:]] - total[at[:-1]]) + n.astype(np.uint64))
        row = np.zeros(len(n), _ROW)
        row["known"] = ~np.asarray(ids.is_null().to_numpy(zero_copy_only=False))
        row["id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
        row["set"], row["n"] = name, n
        self.sets.append(np.repeat(name, n)), self.keys.append(key), self.rows.append(row)
        self.held += len(key) + len(n)

    def flush(self) -> pa.RecordBatch:
        owner, key, rows = (np.concatenate(x) for x in (self.sets, self.keys, self.rows))
        self.clear()
        order = np.lexsort((owner, key))
        owner, key = owner[order], key[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
        owner, key = owner[fresh], key[fresh]
        first, n = _runs(key)
        rank = np.arange(len(key)) - np.repeat(first, n)
        straight = np.isin(key, self.common) | (rank >= MANY)
        self.common = np.union1d(self.common, key[first][n >= MANY])
        common = np.zeros(int(straight.sum()), _COMMON)
        common["set"], common["key"] = owner[straight], key[straight]
        owner, key = owner[~straight], key[~straight]
        bucket, low = _split(key, self.bits)
        order = np.lexsort((low, owner, bucket))
        owner, low, bucket = owner[order], low[order], bucket[order]
        home = _split(common["set"], self.bits)[0]
        order = np.argsort(home, kind="stable")
        common, home = common[order], home[order]
        name, at = np.unique(rows["set"], return_index=True)  # in order, so by their buckets too
        sizes = np.zeros(len(name), _SIZE)
        sizes["set"], sizes["n"] = name, rows["n"][at]
        sizes = sizes[sizes["n"] > 0]
        own = _split(sizes["set"], self.bits)[0]
        turn = ((np.arange(len(rows)) + self.dealt) % (1 << self.bits)).astype(np.uint64)
        self.dealt += len(rows)
        order = np.argsort(turn, kind="stable")
        rows, turn = rows[order], turn[order]
        out = []
        for b in np.unique(bucket):
            lo, hi = np.searchsorted(bucket, [b, b + np.uint64(1)])
            out.append((int(b), None, _pack(owner[lo:hi], low[lo:hi]), None, None, None))
        for h in np.unique(np.concatenate([home, own, turn])):
            parts = (x[slice(*np.searchsorted(at, [h, h + np.uint64(1)]))].tobytes() for x, at in ((common, home), (sizes, own), (rows, turn)))
            out.append((int(h), int(h), None, *parts))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _DEALT)], schema=_DEALT)


def _deal(bits: int, size: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = _Dealer(bits, size)
        for batch in batches:
            for a, z in words.text_slices(batch.column(1)):
                dealer.add(batch.column(0).slice(a, z - a), batch.column(1).slice(a, z - a))
                if dealer.held >= HELD:
                    yield dealer.flush()
        if dealer.rows:
            yield dealer.flush()
        del dealer
        give_back()

    return deal


_FIELDS = "bucket int, home int, items binary, common binary, sizes binary, rows binary"


def _count(bits: int):
    """One bucket of shingles: those in two sets or more, with that number (``MANY`` at most), packed in one row for each
    bucket of their sets; what is meant for these goes on. A bucket is counted in pieces, which bounds what is unpacked at once."""

    def piece(blobs: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for blob in blobs:
            owner, low, _ = _unpack(blob)
            mine = low >> np.uint64(8 * KEY - FINER) == k
            found.append((owner[mine], low[mine]))
        owner, low = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((owner, low))
        return owner[order], low[order]

    def count(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        meant = pc.is_valid(table.column("home"))
        blobs = table.column("items").filter(pc.invert(meant)).to_pylist()
        found = []
        for k in range(1 << FINER) if blobs else ():
            owner, low = piece(blobs, k)
            fresh = np.ones(len(low), bool)
            fresh[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
            owner, low = owner[fresh], low[fresh]
            n = np.repeat(*[_runs(low)[1]] * 2)
            shared = n > 1
            found.append((owner[shared], low[shared], np.minimum(n[shared], MANY).astype(np.uint8)))
        out = []
        if found:  # of all pieces on end: a row for each bucket of sets, not one for each piece and bucket
            owner, low, n = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(owner, kind="stable")
            owner, low, n = owner[order], low[order], n[order]
            home = _split(owner, bits)[0]
            for h in np.unique(home):
                lo, hi = np.searchsorted(home, [h, h + np.uint64(1)])
                out.append((b, int(h), _pack(owner[lo:hi], low[lo:hi], n[lo:hi]), None, None, None))
        counted = pa.table([pa.array(c, t.type) for c, t in zip(zip(*out) if out else [[]] * len(_DEALT), _DEALT)], schema=_DEALT)
        return pa.concat_tables([table.filter(meant).select(_DEALT.names).cast(_DEALT), counted])

    return count


_SETS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("set", pa.int64()), ("shared", pa.binary())])


def _gather(bits: int, percent: int):
    """The rows of one bucket of sets, and its sets whose prefix holds a shared shingle, with their shared shingles, rare
    first. Its sets are put together in pieces, by the bits after those that name the bucket."""

    def piece(set_: np.ndarray, k: int) -> np.ndarray:
        return (set_ << np.uint64(bits)) >> np.uint64(64 - FINER) == k

    def able(table: pa.Table, common: np.ndarray, sizes: np.ndarray, k: int) -> tuple:
        common, sizes = common[piece(common["set"], k)], sizes[piece(sizes["set"], k)]
        parts = [(common["set"], common["key"] >> np.uint64(64 - bits - 8 * KEY), np.full(len(common), MANY, np.uint8))]
        for x, b in zip(table.column("items"), table.column("bucket")):
            if x.as_py() is not None:
                owner, low, n = _unpack(x.as_py(), np.uint8)
                mine = piece(owner, k)
                parts.append((owner[mine], low[mine] | np.uint64(b.as_py() << 8 * KEY), n[mine]))
        owner, key, n = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((key, n, owner))
        owner, key = owner[order], key[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
        owner, key = owner[fresh], key[fresh]
        first, count = _runs(owner)
        name, at = np.unique(sizes["set"], return_index=True)
        size = sizes["n"][at].astype(np.int64)[np.searchsorted(name, owner[first])]
        able = np.flatnonzero(size - count < size + (-percent * size) // 100 + 1)  # n - ceil(percent n / 100) + 1
        return size[able], owner[first[able]], [key[first[i] : first[i] + count[i]].tobytes() for i in able]

    def gather(table: pa.Table) -> pa.Table:
        rows, common, sizes = (
            np.frombuffer(b"".join(x.as_py() or b"" for x in table.column(c)), kind) for c, kind in (("rows", _ROW), ("common", _COMMON), ("sizes", _SIZE))
        )
        found = [able(table, common, sizes, k) for k in range(1 << FINER)]
        size, name = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        return pa.table(
            [
                pa.concat_arrays([pa.array(rows["id"], pa.int64(), mask=~rows["known"]), pa.nulls(len(name), pa.int64())]),
                pa.array(np.concatenate([rows["n"].astype(np.int64), size])),
                pa.array(np.concatenate([rows["set"], name]).view(np.int64)),
                pa.array([None] * len(rows) + [x for f in found for x in f[2]], pa.binary()),
            ],
            schema=_SETS,
        )

    return gather


def _prefixes(percent: int):
    """Rows (token, set, n, at, parts) of the shared shingles in each prefix; ``at`` counts the rarer shingles, ``parts``
    has a byte for the number of shared shingles in each part, null if one is too large."""
    schema = pa.schema([(n, pa.int64()) for n in ("token", "set", "n", "at", "parts")])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
                key = np.frombuffer(blob, np.uint64)
                alone, reach = n - len(key), n - -(-percent * n // 100) + 1
                key = key[: reach - alone]
                m = len(key)
                parts = np.bincount((np.frombuffer(blob, np.uint64) & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS)
                parts = int(parts.astype(np.uint8).view(np.int64)[0]) if parts.max() < 256 else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array([name] * m), pa.array([n] * m), pa.array(alone + np.arange(m)), pa.array([parts] * m, pa.int64())],
                    schema=schema,
                )

    return prefixes


def _similar(percent: int):
    """Keeps the pairs whose sets overlap enough; the shared shingles alone can be in both."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, x, y = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(a)):
                both = np.concatenate([np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (na[i] + nb[i] - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return similar


def shingle_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, buckets: int | None = None) -> DataFrame:
    """Two kinds of rows (id, n, set, shared). With a null ``shared``: every row of ``docs``, the size and the name of
    its set. Others: the sets whose prefix holds a shared shingle, with all their shared shingles, rare first.

    ``buckets`` is rounded up to a power of two; a task works on one at a time. By default it is the bytes of all texts
    over ``BUCKET_BYTES``, the shuffle partitions at least, so a bucket does not grow with the input.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if buckets is None:
        total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        buckets = max(shuffle_partitions(docs.sparkSession), total // BUCKET_BYTES)
    bits = max(1, (buckets - 1).bit_length())
    dealt = rows.mapInArrow(_deal(bits, size), _FIELDS)
    counted = dealt.groupBy("bucket").applyInArrow(giving_back(_count(bits)), _FIELDS)
    return counted.groupBy("home").applyInArrow(giving_back(_gather(bits, percent)), "id long, n long, set long, shared binary")


def _check(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("set").alias(side), F.col("n").alias(f"n{side}"), F.col("shared").alias(f"x{side}")), side)
    return pairs.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_similar(percent), "a long, b long")


def _may_link(x: str, y: str, percent: int):
    """Length, position and suffix filters for two sets that meet on their first common shingle."""
    c = lambda side, name: F.col(f"{side}.{name}")
    need = percent * (c(x, "n") + c(y, "n"))  # (100 + percent) * overlap must reach it
    rest = F.least(c(x, "n") - c(x, "at"), c(y, "n") - c(y, "at"))
    each = lambda side, k: F.shiftright(c(side, "parts"), 8 * k).bitwiseAND(255)
    parts = sum(F.when(each(x, k) < each(y, k), each(x, k)).otherwise(each(y, k)) for k in range(PARTS))
    return (
        (100 * F.least(c(x, "n"), c(y, "n")) >= percent * F.greatest(c(x, "n"), c(y, "n")))
        & ((100 + percent) * rest >= need)
        & (c(x, "parts").isNull() | c(y, "parts").isNull() | ((100 + percent) * parts >= need))
    )


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, buckets: int | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row: texts whose sets of ``size``-word shingles have a Jaccard
    similarity of ``percent`` / 100 or more are linked, and component_id is the smallest id that links reach.

    Null and empty texts and texts of white space have no shingle and are linked with nothing. A row without an id
    gets a null component and never names one; rows that repeat an id keep their rows. Other columns are ignored, an
    empty table gives no rows. Sets are told apart by 64-bit names and shingles by 48 bits and more.
    """
    folder = shared_folder(docs.sparkSession)
    table = stored(shingle_table(docs, id_col, text_col, size, percent, buckets), folder, "sets")
    sets = table.where("shared is not null").select("set", "n", "shared")
    rows = stored(sets.mapInArrow(_prefixes(percent), "token long, set long, n long, at long, parts long"), folder, "prefixes")
    links, label = _central_links(rows, sets, percent, folder)
    x, y = label(rows).alias("x"), label(rows).alias("y")
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.home") < F.col("y.home")) & _may_link("x", "y", percent))
    rest = rest.select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b")).distinct()
    links = [*links, stored(_check(rest, sets, percent), folder, "links")]
    of_set = connected_components(_union(links)).select(F.col("node").alias("set"), "component")
    named = table.where("shared is null").join(of_set, "set", "left").select("id", "n", F.coalesce("component", "set").alias("component"))
    named = stored(named, folder, "named")
    lowest = named.where("n > 0").groupBy("component").agg(F.min("id").alias("low"))
    # Texts without words share an empty set, and a group of one has no name but its own id.
    lowest = lowest.join(named.where("n > 0").groupBy("component").count().where("count > 1").drop("count"), "component", "left_semi")
    out = named.join(lowest, "component", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("low", "id")).alias("component_id"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def _central_links(rows: DataFrame, sets: DataFrame, percent: int, folder: str):
    """Links of each set with the central set of the buckets it is in, and a function that adds the components found.

    Another centre is tried as long as the pairs left to compare are many; what is left after that is compared by the
    caller, so no link depends on the choice of the centres.
    """
    links, homes = [], None

    def label(t: DataFrame) -> DataFrame:
        if homes is None:
            return t.withColumn("home", F.col("set"))
        return t.join(homes, "set", "left").withColumn("home", F.coalesce("home", "set"))

    for turn in range(CENTRES):
        now = label(rows)
        if turn:
            crowd = now.groupBy("token", "home").count().groupBy("token")
            left = crowd.agg((F.sum("count") * F.sum("count") - F.sum(F.col("count") * F.col("count"))).alias("pairs"))
            left, total = left.agg(F.sum("pairs"), F.count("*")).first()
            if (left or 0) <= 2 * PAIRS_A_TOKEN * total:
                break
        # The first centre has the fewest rare shingles; later ones come from other components.
        by = [F.col("at") / F.col("n"), "n", "set"] if turn == 0 else [F.xxhash64("home", F.lit(turn)), F.col("at") / F.col("n"), "set"]
        centre = now.groupBy("token").agg(F.min(F.struct(*[F.col(c).alias(f"k{i}") if isinstance(c, str) else c.alias(f"k{i}") for i, c in enumerate(by)], "n", "at", "parts", F.col("set").alias("who"), F.col("home").alias("of"))).alias("c"), F.count("*").alias("m"))
        centre = centre.where("m > 1").select("token", F.col("c.who").alias("set"), F.col("c.of").alias("home"), "c.n", "c.at", "c.parts").alias("y")
        pairs = now.alias("x").join(centre, (F.col("x.token") == F.col("y.token")) & (F.col("x.home") != F.col("y.home")) & _may_link("x", "y", percent))
        pairs = pairs.select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b")).distinct()
        links.append(stored(_check(pairs, sets, percent), folder, f"central-{turn}"))
        homes = stored(connected_components(_union(links)).select(F.col("node").alias("set"), F.col("component").alias("home")), folder, f"homes-{turn}")
    return links, label
