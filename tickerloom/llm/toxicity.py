"""Toxicity: class-conditional Kneser-Ney models of word pairs, one of toxic and one of ordinary texts.

Each class has its own counts of pairs (a word after the one before it) and its own continuation counts (in how many
pairs a word is the second one), with a discount off each. Below them are continuation counts that both classes share,
so an expression that neither has seen says little. A text is judged by the difference of its two log-likelihoods,
divided by its length; as a long text may hold one toxic expression, also by the highest difference of its words, pairs
and runs of words, sorted by how often such an expression was counted. A logistic function, fitted on labelled rows that
were not counted, turns these into a score.

Words are exact, and what is counted grows with the corpus, so nothing of it is sent to all tasks. The texts stay where
they are, in *slices* of some megabytes. A slice asks for its distinct pairs and words once: sorted keys, dealt by their
first bits to buckets, each of which holds the counts of its own keys and answers row by row. Answers go back to their
slice, and the texts are read again.

- The first question adds up pairs. Its answer also says which counted pairs a slice is the first to have, so each
  distinct pair is taken once for the continuation counts, which go with the second question.
- The second question adds up words and gets their counts as second words and as contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .characters import has_letter
from .slices import Slices, checked
from .storage import give_back, giving_back, shared_folder, stored

DISCOUNT = 0.75
#: Words of the runs that are judged besides the whole text.
RUN = 8
#: Highest numbers of times that the rare and the known expressions were counted; all others are frequent.
TIERS = (2, 8)
FEATURES = ["whole", "run", "word_rare", "word_known", "word_frequent", "pair_rare", "pair_known", "pair_frequent", "unknown", "length"]
#: Labelled rows that the logistic function is fitted on, at most.
FIT_ROWS = 20_000
#: Bytes of text for each bucket of keys, some million questions, and bounds of the number of buckets as powers of two.
BUCKET_BYTES, BUCKET_BITS = 8 << 20, (6, 16)
#: Bytes of text whose words are found at a time.
PIECE = 1 << 17
#: What comes before the first word of a text.
START = np.uint64(0x5BD1E995A7C1F3B1)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word and its text.

    A word is a run without white space, less the ASCII marks at its ends unless it has nothing else. Characters of three
    and more bytes of UTF-8 are words of their own, as most scripts without spaces have them.
    """
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    first[offsets] = last[offsets] = True
    lead = (data & 0xC0) != 0x80
    wide = (data[lead] >= 0xE0)[np.cumsum(lead) - 1]
    inside = ~words._tables()[0][data]
    begin = first[:-1].copy()
    begin[1:] |= ~inside[:-1] | (lead[1:] & (wide[1:] | wide[:-1]))
    begin &= inside
    stop = last[1:].copy()
    stop[:-1] |= ~inside[1:] | begin[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop & inside) + 1
    solid = (data >= 0x80) | ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90))
    at = np.arange(n)
    after = np.minimum.accumulate(np.where(solid, at, n)[::-1])[::-1][starts]
    before = np.maximum.accumulate(np.where(solid, at, -1))[ends - 1] + 1
    some = after < ends
    return np.where(some, after, starts), np.where(some, before, ends), np.searchsorted(offsets, starts, side="right") - 1


class Pairs:
    """The words of some texts: ``word`` and ``pair`` hold the distinct keys in order, ``pair_of`` the place of each
    token's pair, ``text`` its text; ``left`` and ``right`` are the words of each distinct pair."""

    def __init__(self, texts: list[str]):
        tokens, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        texts = pa.array(texts, pa.large_string())
        for a, z in words.text_slices(texts, PIECE):
            data, offsets = words.text_bytes(pc.utf8_lower(texts.slice(a, z - a)))
            starts, ends, text = _tokens(data, offsets)
            tokens.append(words.word_hashes(data, starts, ends, lower=False))
            owners.append((text + a).astype(np.int32))
        tokens, self.text = np.concatenate(tokens), np.concatenate(owners)
        del texts, owners
        new = np.ones(len(tokens), bool)
        new[1:] = self.text[1:] != self.text[:-1]
        self.word = np.unique(np.append(tokens, START))
        start = np.searchsorted(self.word, START)
        word_of = np.searchsorted(self.word, tokens).astype(np.int32)
        context = np.append(np.int32(start), word_of[:-1])[: len(tokens)].astype(np.int32)
        context[new] = start
        # A pair's key follows from its words' keys, so distinct pairs of places give distinct keys.
        keys = words.mix(self.word[context] * np.uint64(3) + tokens)
        del tokens, new
        order = np.argsort(keys).astype(np.int32)
        keys = keys[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        self.pair = keys[first]
        del keys
        self.left, self.right = context[order[first]], word_of[order[first]]
        self.pair_of = np.empty(len(order), np.int32)
        self.pair_of[order] = np.cumsum(first, dtype=np.int32) - 1


def packed_counts(counts: np.ndarray) -> bytes:
    """Whole numbers as bytes: one byte each, which is 255 for those whose two bytes follow at the end, and these are 65535
    for those that take eight bytes after them; nothing if all are 0."""
    if not counts.any():
        return b""
    large = counts[counts >= 255]
    huge = large[large >= 65535]
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + np.minimum(large, 65535).astype("<u2").tobytes() + huge.astype("<i8").tobytes()


def unpacked_counts(blob: bytes, n: int) -> np.ndarray:
    if not blob:
        return np.zeros(n, np.int64)
    out = np.frombuffer(blob, np.uint8, n).astype(np.int64)
    if len(blob) > n:
        large = np.flatnonzero(out == 255)
        out[large] = np.frombuffer(blob, "<u2", len(large), n)
        at = n + 2 * len(large)
        if len(blob) > at:
            out[large[out[large] == 65535]] = np.frombuffer(blob, "<i8", (len(blob) - at) // 8, at)
    return out


class Keys:
    """How keys are dealt: the first ``bits`` name the bucket, the next ``width`` bytes are sent. A bucket's keys are told
    apart by so many bytes that a question meets another key's count at odds of less than 1 to 4,096 even if every fourth
    byte of the texts began a new counted key (in texts as they are, about 1 to 100,000)."""

    def __init__(self, text_bytes: int):
        low, high = BUCKET_BITS
        size = max(1, text_bytes).bit_length()
        self.bits = min(high, max(low, size - BUCKET_BYTES.bit_length() + 1))
        self.width = min(8, -(-(size - 2 + 12 - self.bits) // 8))

    def parts(self, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bucket, start, stop) of the ordered keys of each bucket."""
        bucket = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, np.int64)
        yield from zip(bucket[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)])

    def sent(self, keys: np.ndarray) -> bytes:
        """The ordered keys of a bucket: their number, how many bytes a difference takes, and the differences; those that
        take more follow with their places."""
        rest = (keys << np.uint64(self.bits)) >> np.uint64(64 - 8 * self.width)
        step = np.diff(rest, prepend=np.uint64(0))
        usual = 4 * int(rest[-1]) // len(rest) if len(rest) else 0  # few are four times the mean
        width = min(self.width, max(1, -(-usual.bit_length() // 8)))
        most = np.uint64((1 << 8 * width) - 1)
        large = np.flatnonzero(step >= most) if width < self.width else np.zeros(0, np.int64)
        short = np.minimum(step, most) if width < self.width else step
        low = short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        return np.array([len(rest), width], "<u4").tobytes() + low.tobytes() + large.astype("<u4").tobytes() + step[large].astype("<u8").tobytes()

    def received(self, blob: bytes) -> np.ndarray:
        n, width = np.frombuffer(blob, "<u4", 2).tolist()
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, 8).reshape(n, width)
        step, at = wide.view("<u8").ravel().astype(np.uint64), 8 + n * width
        large = (len(blob) - at) // 12
        step[np.frombuffer(blob, "<u4", large, at)] = np.frombuffer(blob, "<u8", large, at + 4 * large)
        return np.cumsum(step, dtype=np.uint64)


_ASKED = "bucket int, part int, slice int, keys binary, counts array<binary>"
_ANSWER = "part int, slice int, bucket int, counts array<binary>, totals array<bigint>"


def _questions(keys: Keys, asked: np.ndarray, counts: list[np.ndarray], part: int, number: int) -> Iterator[tuple]:
    """The questions of one slice, one at least."""
    some = False
    for bucket, a, z in keys.parts(asked):
        some = True
        yield bucket, part, number, keys.sent(asked[a:z]), [packed_counts(c[a:z]) for c in counts]
    if not some:
        yield 0, part, number, keys.sent(asked), [b""] * len(counts)


def _answers(keys: Keys, kinds: int, first: bool):
    """The sums of one bucket's counts for each question. If asked, after the ``kinds`` counts comes for each whether this
    slice is the first one to count the key. ``totals`` are the bucket's sums and numbers of keys by kind, and the number
    of keys with one of the first two."""

    def answers(table: pa.Table) -> pa.Table:
        parts, slices = table.column("part").to_numpy(), table.column("slice").to_numpy()
        order = np.lexsort((slices, parts))
        asked = {i: keys.received(table.column("keys")[i].as_py()) for i in order.tolist()}
        own = {i: [unpacked_counts(b, len(asked[i])) for b in table.column("counts")[i].as_py()] for i in order.tolist()}
        some = {i: np.flatnonzero(sum(own[i]) > 0) for i in order.tolist()}
        known, at = np.unique(np.concatenate([asked[i][some[i]] for i in order.tolist()]), return_inverse=True)
        sums = [np.zeros(len(known), np.int64) for _ in range(kinds)]
        seen = np.zeros((kinds, len(known)), bool)
        rows, done = [], 0
        for i in order.tolist():
            mine = at[done : done + len(some[i])]
            done += len(some[i])
            new = [np.zeros(len(asked[i]), np.int64) for _ in range(kinds)]
            for k in range(kinds):
                np.add.at(sums[k], mine, own[i][k][some[i]])
                fresh = (own[i][k][some[i]] > 0) & ~seen[k, mine]
                new[k][some[i][fresh]] = 1
                seen[k, mine[fresh]] = True
            own[i] = new
        for i in order.tolist():
            place = np.minimum(np.searchsorted(known, asked[i]), max(0, len(known) - 1))
            hit = known[place] == asked[i] if len(known) else np.zeros(len(asked[i]), bool)
            counts = [np.where(hit, s[place], 0) if len(known) else np.zeros(len(hit), np.int64) for s in sums]
            rows.append((int(parts[i]), int(slices[i]), table.column("bucket")[i].as_py(), [packed_counts(c) for c in [*counts, *(own[i] if first else [])]], None))
        rows.append((-1, 0, 0, None, [*(int(s.sum()) for s in sums), *(int((s > 0).sum()) for s in sums), int((sums[0] + sums[1] > 0).sum())]))
        types = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["part", "slice", "bucket", "counts", "totals"])

    return answers


def _split(sides: list) -> tuple:
    """The marks of a slice and the answers to its two questions, in order of the buckets."""
    own, *answers = sides
    return own, [r["counts"] for r in answers if r["kind"] == 1], [r["counts"] for r in answers if r["kind"] == 2]


def _kinds(marks: list, n: int) -> np.ndarray:
    """The class of each row, -1 if it is not counted, from (row, toxic, fitted)."""
    kind = np.full(n, -1)
    for row, toxic, fitted in marks:
        if not fitted:
            kind[row] = toxic
    return kind


def _ask_pairs(keys: Keys, path: list[str]):
    def ask(item: tuple) -> Iterator[tuple]:
        rows, sides = item
        own, _, _ = _split(sides)
        pairs, kind = Pairs(checked(rows, path, own["mark"])), _kinds(own["marks"], len(rows))
        of = kind[pairs.text]
        give_back()
        yield from _questions(keys, pairs.pair, [np.bincount(pairs.pair_of[of == k], minlength=len(pairs.pair)) for k in (0, 1)], own["part"], own["slice"])

    return ask


def _joined_counts(lists: list, blocks: list[int]) -> list[np.ndarray]:
    """The counts of all buckets' answers on end; ``blocks`` are the numbers of keys that were asked for in each."""
    if not blocks:
        return [np.zeros(0, np.int64) for _ in lists[0]]
    return [np.concatenate([unpacked_counts(counts[k], n) for counts, n in zip(lists, blocks)]) for k in range(len(lists[0]))]


def _sizes(keys: Keys, asked: np.ndarray) -> list[int]:
    return [z - a for _, a, z in keys.parts(asked)]


def _ask_words(keys: Keys, path: list[str]):
    """Adds by word: pairs that it ends (by class) which this slice is the first to have, those that it begins, and how
    often it begins one."""

    def ask(item: tuple) -> Iterator[tuple]:
        rows, sides = item
        own, answer, _ = _split(sides)
        pairs, kind = Pairs(checked(rows, path, own["mark"])), _kinds(own["marks"], len(rows))
        of, n = kind[pairs.text], len(pairs.word)
        new0, new1 = _joined_counts(answer, _sizes(keys, pairs.pair))
        counts = [np.bincount(side[new > 0], minlength=n) for side in (pairs.right, pairs.left) for new in (new0, new1)]
        counts += [np.bincount(pairs.left[pairs.pair_of[of == k]], minlength=n) for k in (0, 1)]
        give_back()
        yield from _questions(keys, pairs.word, counts, own["part"], own["slice"])

    return ask


def pair_ratios(pairs: tuple, left: tuple, right: tuple, totals: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Log of the toxic model's probability of a pair's second word over the ordinary model's: of the models of pairs, and
    of those of single words.

    ``pairs`` are the counts by class. ``left`` are the first word's distinct pairs and tokens by class, ``right`` the
    second one's continuation counts by class, and ``totals`` the sums of these and the numbers of words that have one: by
    class, and of both.
    """
    k0, k1, u0, u1, u = totals
    both, total = right[0] + right[1], max(1, k0 + k1)
    shared = np.maximum(both - DISCOUNT, 0) / total + (DISCOUNT * u / total if u else 1.0) / (u + 1)
    words_, whole = [], []
    for c, (k, kinds) in enumerate(((k0, u0), (k1, u1))):
        one = (np.maximum(right[c] - DISCOUNT, 0) + DISCOUNT * kinds * shared) / k if k else shared
        # A word that begins tokens begins a pair, also if that one's key met another's and was not counted as new.
        distinct, tokens = np.maximum(left[c], left[c + 2] > 0), left[c + 2]
        seen = np.maximum(tokens, 1)
        words_.append(one)
        whole.append(np.where(tokens > 0, (np.maximum(pairs[c] - DISCOUNT, 0) + DISCOUNT * distinct * one) / seen, one))
    return np.log(whole[1] / whole[0]), np.log(words_[1] / words_[0])


def _highest(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The highest value of each text, 0 at least; the tokens of a text are on end."""
    out = np.zeros(n)
    np.maximum.at(out, text, values)
    return out


def text_features(pairs: Pairs, counts: list[np.ndarray], known: list[np.ndarray], totals: list[int], n: int) -> np.ndarray:
    """FEATURES of n texts from the answers for their pairs and words."""
    k0, k1, t0, t1, n0, n1 = known
    left, right = pairs.left, pairs.right
    pair, word = pair_ratios((counts[0], counts[1]), (t0[left], t1[left], n0[left], n1[left]), (k0[right], k1[right]), totals)
    often, seen = counts[0] + counts[1], (k0 + k1)[right]
    text, of = pairs.text, pairs.pair_of
    length = np.bincount(text, minlength=n)
    value = pair[of]
    out = np.zeros((n, len(FEATURES)))
    out[:, 0] = np.bincount(text, weights=value, minlength=n) / np.maximum(length, 1)
    sums = np.concatenate([[0.0], np.cumsum(value)])
    end = np.minimum(np.arange(len(value)) + RUN, np.cumsum(length)[text]) if len(value) else np.zeros(0, np.int64)
    out[:, 1] = _highest((sums[end] - sums[:-1]) / RUN, text, n)
    at = 2
    for ratio, count in ((word, seen), (pair, often)):
        tier = np.searchsorted(TIERS, count)  # 0 to 2
        for t in range(3):
            mine = np.where((tier == t) & (count > 0), ratio, 0.0)
            out[:, at] = _highest(mine[of], text, n)
            at += 1
    out[:, -2] = np.bincount(text, weights=seen[of] == 0, minlength=n) / np.maximum(length, 1)
    out[:, -1] = np.log(np.maximum(length, 2))
    return out


def _describe(keys: Keys, path: list[str], totals: list[int]):
    """(part, slice, features of every row and whether it has a letter, features and class of the rows to fit on)."""

    def describe(item: tuple) -> tuple:
        rows, sides = item
        own, pair_answer, word_answer = _split(sides)
        texts = checked(rows, path, own["mark"])
        pairs = Pairs(texts)
        counts = _joined_counts(pair_answer, _sizes(keys, pairs.pair))
        x = text_features(pairs, counts, _joined_counts(word_answer, _sizes(keys, pairs.word)), totals, len(texts))
        letter = has_letter(texts)
        fit = [(*x[r].tolist(), float(toxic)) for r, toxic, fitted in own["marks"] if fitted and letter[r]]
        give_back()
        return own["part"], own["slice"], own["mark"], np.column_stack([x, letter]).astype("<f8").tobytes(), np.array(fit, "<f8").tobytes()

    return describe


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, held to zero by one row's weight; the features are scaled by their spread. A
    step that does not lower the loss is halved.

    Products are sums over columns: this runs on the driver, where the threads of linear algebra may wait for ever.
    """
    from .packing import solved

    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - centre) / spread, np.ones(len(x))])
    d = z.shape[1]
    w, hold = np.zeros(d), np.full(d, 1.0)
    hold[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        margin = np.einsum("ij,j->i", z, w)
        return float((np.logaddexp(0, margin) - y * margin).sum() + (hold * w * w).sum() / 2)

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", z, w), -30, 30)))
        curve = z * (p * (1 - p))[:, None]
        step = solved(np.einsum("ij,ik->jk", curve, z) + np.diag(hold + 1e-9), np.einsum("ij,i->j", z, y - p) - hold * w)
        while (new := loss(w + step)) > now and np.abs(step).max() > 1e-10:
            step = step / 2
        if not new <= now:
            break
        w, now = w + step, new
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * centre / spread).sum())


def _scored(model: np.ndarray | None, base: float, kept: list[str], path: list[str]):
    def scored(item: tuple) -> Iterator[tuple]:
        rows, (side,) = item
        checked(rows, path, side["mark"])
        x = np.frombuffer(side["rows"], "<f8").reshape(len(rows), len(FEATURES) + 1)
        score = np.full(len(x), base)
        if model is not None:
            z = np.clip((x[:, :-1] * model[:-1]).sum(axis=1) + model[-1], -30, 30)
            score = np.where(x[:, -1] > 0, 1 / (1 + np.exp(-z)), base)
        for row, value in zip(rows, score.tolist()):
            yield (*(row[c] for c in kept), value, int(value >= 0.5))

    return scored


def fit_labels(labels: DataFrame, id_col: str = "doc_id", rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` labels, the first by the hash of their id: a bounded sample for the logistic function."""
    return labels.where("toxic in (0, 1)").select(id_col, "toxic").orderBy(F.xxhash64(id_col), id_col, "toxic").limit(rows)


def with_toxicity(docs: DataFrame, counted: DataFrame, fitted: DataFrame, kept: list[str], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``kept`` columns of every row of ``docs`` with its score (0 to 1) and ``predicted`` (1 from 0.5). ``text_col`` names
    a string column, or a string field of a structure.

    ``counted`` and ``fitted`` are labels (doc_id, toxic) of rows whose texts are counted and fitted on, see
    ``fit_labels``; they are disjoint. A label holds for all rows with its id, the higher one of several. Rows with a null
    label teach nothing, rows with a null text or id neither. Null and empty texts and texts without a letter get the
    share of toxic rows in ``fitted``, below a half; so does every text if one class has no row. Rows that repeat stay,
    an empty table gives no rows. ``docs`` is read several times, see ``Slices``.
    """
    folder, path = shared_folder(docs.sparkSession), text_col.split(".")
    rows = docs.select(*dict.fromkeys([*kept, path[0], id_col]))
    slices = Slices(rows, path, id_col)
    places = stored(slices.places(), folder, "places")
    marks = []
    for table, use in ((counted, False), (fitted, True)):
        table = table.where("toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
        marks.append(places.join(table.hint("merge"), "id").select("id", "part", "slice", F.struct("row", "toxic", F.lit(use).alias("fitted")).alias("m")))
    # Of the rows to fit on, one for each id: so they are no more than the labels.
    once = marks[1].groupBy("id").agg(F.min(F.struct("part", "slice", "m")).alias("x")).select("x.part", "x.slice", "x.m")
    marks = marks[0].drop("id").union(once).groupBy("part", "slice").agg(F.collect_list("m").alias("marks"))  # a slice's rows
    marked = places.groupBy("part", "slice").agg(F.max("mark").alias("mark")).join(marks, ["part", "slice"], "left")
    marked = stored(marked.withColumn("marks", F.coalesce("marks", F.array().cast(marks.schema["marks"].dataType))), folder, "marks")
    keys = Keys(docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0)
    sides = marked.select("part", "slice", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), "mark", "marks")

    def answered(asked: RDD, kinds: int, first: bool, name: str) -> DataFrame:
        table = slices.table(asked, _ASKED)
        return stored(table.groupBy("bucket").applyInArrow(giving_back(_answers(keys, kinds, first)), _ANSWER), folder, name, "zstd")

    def with_answers(sides: DataFrame, table: DataFrame, kind: int, first: int, n: int) -> DataFrame:
        counts = F.slice("counts", first, n).alias("counts")
        return sides.unionByName(table.where("part >= 0").select("part", "slice", F.lit(kind).alias("kind"), "bucket", counts), allowMissingColumns=True)

    order = ["kind", "bucket"]
    pairs = answered(slices.beside(sides, order).flatMap(_ask_pairs(keys, path)), 2, True, "pairs")
    new = with_answers(sides, pairs, 1, 3, 2)
    known = answered(slices.beside(new, order).flatMap(_ask_words(keys, path)), 6, False, "words")
    sides = with_answers(with_answers(sides, pairs, 1, 1, 2), known, 2, 1, 6)
    sums = [F.coalesce(F.sum(F.col("totals")[i]), F.lit(0)).alias(f"t{i}") for i in (0, 1, 6, 7, 12)]
    totals = list(known.where("part < 0").agg(*sums).first())
    described = slices.beside(sides, order).map(_describe(keys, path, totals))
    described = stored(slices.table(described, "part int, slice int, mark long, rows binary, fit binary"), folder, "described")
    fit = [np.frombuffer(r[0], "<f8") for r in described.where("length(fit) > 0").select("fit").collect()]  # of FIT_ROWS labels
    fit = np.concatenate([np.zeros(0), *fit]).reshape(-1, len(FEATURES) + 1)
    y = fit[:, -1]
    base = min(float(y.mean()), 0.49) if len(y) else 0.0
    model = _fit(fit[:, :-1], y) if 0 < y.sum() < len(y) else None
    scored = slices.beside(described.select("part", "slice", "mark", "rows"), []).flatMap(_scored(model, base, kept, path))
    fields = [*(rows.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return slices.table(scored, T.StructType(fields))
