import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tickerloom.llm import repeats, words


def by_hand(texts, length):
    """(bytes, removed, spans, digest) of each text, from all strings."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~gone].tobytes())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def by_spark(spark, texts, length, parts=3):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    rows = repeats.repeat_digests(repeats.without_repeats(docs, length=length)).collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r["doc_id"])]


def words_of(rng, n):
    return " ".join("".join(rng.choice("abcdéfgh") for _ in range(rng.randrange(1, 9))) for _ in range(n))


@pytest.mark.parametrize("length", [400, 37])
def test_equals_all_strings(spark, length):
    """Copies, near copies, passages shared at both ends, in the middle and twice in a text, and periodic texts."""
    rng = random.Random(length)
    base, passage = words_of(rng, 500), words_of(rng, length // 2)
    texts = [base, base, base[:900], None, "", "short", passage, passage[: len(passage) // 2]]
    for _ in range(12):  # near copies
        cut = rng.randrange(len(base) - 5)
        texts.append(base[:cut] + rng.choice(["", "X", "é~"]) + base[cut + rng.randrange(4) :])
    for _ in range(25):
        own = words_of(rng, rng.randrange(5, 200))
        cut, a, z = rng.randrange(len(own)), rng.randrange(len(passage)), rng.randrange(len(passage))
        texts.append(own[:cut] + passage[min(a, z) : max(a, z)] + own[cut:])
    texts += ["a" * 1000, "a" * (length + 1), "a" * length, "xy" * 700 + "z", "line of text\n" * 90, base[:500] + "|" + base[:500]]
    texts += [words_of(rng, 60) for _ in range(10)]
    assert by_spark(spark, texts, length) == by_hand(texts, length)


def test_a_passage_in_very_many_texts(spark):
    rng = random.Random(1)
    passage = words_of(rng, 90)
    texts = [words_of(rng, 25) + passage[i % 7 :] + words_of(rng, 25) for i in range(600)]
    assert by_spark(spark, texts, 400, 7) == by_hand(texts, 400)


def test_long_texts_in_pieces(spark, monkeypatch):
    """Pieces that end inside a repeated passage change nothing."""
    rng = random.Random(2)
    base = words_of(rng, 3000)
    texts = [base, "x" + base[100:9000] + words_of(rng, 800), "z" * 4000, words_of(rng, 900)]
    docs = [t.encode() for t in texts]
    for length in (400, 60):
        monkeypatch.setattr(repeats, "PIECE", 1500)
        runs = np.concatenate(list(repeats.text_runs(pa.array(texts), length)))
        monkeypatch.undo()
        places = lambda rows: sorted((t, s + k) for t, s, n in rows for k in range(n))
        flat = [(r["text"], r["start"] + j * r["stride"], r["n"]) for r in runs for j in range(r["reps"])]
        assert len(places(flat)) == sum(len(d) - length + 1 for d in docs) and len(set(places(flat))) == len(places(flat))
    got = by_spark(spark, ["long " * 400_000, texts[0]], 400)
    assert got == [(2_000_000, 2_000_000, 1, hashlib.sha256(b"").hexdigest()), *by_hand(texts[:1], 400)]


def test_identifiers_follow_from_the_bytes():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    for length, also in ((400, 100), (37, 9), (33, 8), (4, 1), (401, 100)):
        for n, ids in zip((also, length), repeats.identifiers(data, length, also)):
            named = collections.defaultdict(set)
            for i, x in enumerate(ids.tolist()):
                named[data[i : i + n].tobytes()].add(x)
            assert len(ids) == len(data) - n + 1 and len({next(iter(v)) for v in named.values()}) == len(named)
            assert all(len(v) == 1 for v in named.values())


def test_smallest():
    keys = np.random.default_rng(5).integers(0, 50, 400).astype(np.uint64)
    for width in (1, 2, 7, 301, 400):
        assert (repeats._smallest(keys, width) == [keys[i : i + width].min() for i in range(400 - width + 1)]).all()


def test_repeated_and_missing_ids_clashing_names_and_no_rows(spark):
    text = "word and another one " * 30
    schema = "doc_id long, text string, a string, q long, kept string, _text string, _a long"
    rows = [(1, text, "x", 1, "k", "t", 1), (1, text, "x", 1, "k", "t", 1), (None, "unlike", None, None, None, None, None), (2, None, "y", 2, "", "", 2)]
    got = repeats.without_repeats(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], len(r["kept"]), len(r["spans"])) for r in got) == [(0, 6, 6, 0), (1, 630, 0, 1), (1, 630, 0, 1), (2, 0, 0, 0)]
    assert repeats.without_repeats(spark.createDataFrame([], schema)).count() == 0
