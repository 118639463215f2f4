import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tickerloom.llm import resampling


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=400), min_size=1, max_size=20))
def test_checksums(spans):
    lengths = np.array([len(s) for s in spans])
    got = resampling.span_checksums(np.frombuffer(b"".join(spans), np.uint8), np.cumsum(lengths) - lengths, lengths)
    assert got.tolist() == [zlib.crc32(s) for s in spans]


def test_checksum_of_very_long_spans_and_overlaps():
    data = np.random.default_rng(1).integers(0, 256, 300_000).astype(np.uint8)
    starts, lengths = np.array([0, 5, 7, 63, 100]), np.array([300_000, 64, 65, 128, 299_000])
    want = [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(starts, lengths)]
    assert resampling.span_checksums(data, starts, lengths).tolist() == want
    assert len(resampling.span_checksums(data, starts[:0], lengths[:0])) == 0


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [zlib.crc32(f.encode()) % 10000 for f in [*words, *map(" ".join, zip(words, words[1:]))]]


def by_hand(docs, target):
    own = [features(t) for _, t in docs]
    s, t = (Counter(b for _, f in side for b in f) for side in (own, [features(x) for x in target]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (sum(s.values()) + 10000.0) / ((s[b] + 1.0) * (sum(t.values()) + 10000.0))))
    rows = []
    for (i, _), (words, buckets) in zip(docs, own):
        weight = math.floor(sum(map(gain, buckets)) / len(buckets)) if buckets else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: k for k, r in enumerate(able[: 25 * len(able) // 100], 1)}
    return [(*r[:4], rank.get(r[0])) for r in rows]


def test_equals_the_definition(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "The", "größe", "中文", "x1", "Zürich", "k" * 90, "of", "and", "Å"])
    text = lambda n: "".join(word() + rng.choice([" ", "-", "\n", ", ", "_"]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "?! --"), (1003, "a"), (1004, "w" * 200_000), (1005, text(40_000))]
    target = [text(30).replace("the", "aim") for _ in range(20)] + [None, ""]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = resampling.resampled(table, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert sorted(tuple(r) for r in rows) == by_hand(docs, target)
    assert any(r["rank"] for r in rows)


def test_ties_repeats_null_ids_clashing_names_and_empty_tables(spark):
    schema = "doc_id long, text string, score string, rank long, _words int, bucket int"
    text = "one two three four five six seven eight nine ten " * 3
    docs = spark.createDataFrame([(5, text, "s", 1, 2, 3)] * 4 + [(None, text, None, None, None, None)] * 4, schema)
    target = spark.createDataFrame([("one two",)], "text string")
    rows = resampling.resampled(docs, target).collect()
    assert len(rows) == 8 and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2]
    assert len({(r["doc_id"], r["score"]) for r in rows}) == 2
    assert len(resampling.resampled(docs, target.limit(0)).collect()) == 8
    assert resampling.resampled(docs.limit(0), target).count() == 0


def test_words_do_not_reach_over_texts():
    single, pair, before = resampling.text_features(pa.array(["a b", None, "", "c", "d e f"]))
    assert before.tolist() == [0, 2, 2, 2, 3, 6] and (pair >= 0).tolist() == [True, False, False, True, True, False]
    assert pair[0] == zlib.crc32(b"a b") % 10000 and single[3] == zlib.crc32(b"d") % 10000
