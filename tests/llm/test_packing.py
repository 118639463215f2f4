import collections
import functools
import pathlib
import subprocess
import sys
import zlib

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickerloom.llm import packing


def check(rows, texts, size=packing.SIZE):
    """Every id of every document in one place, all sequences without a gap; returns the share of padding."""
    tokenizer = Tokenizer.from_file(packing.public_vocabulary()[0])
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")
        at = 0
        for r in sorted(pieces.pop(i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not pieces
    padding = total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / max(1, total + padding)


def test_given_documents(sample):
    docs = sample("documents")
    assert check(packing.packed(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()}) < 0.02


def test_special_string_empty_null_and_long_texts(make_docs):
    texts = ["", None, "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "x" * 30_000, "word " * 9_000, "é\U0001f600 \n\n  z", "same", "same"]
    check(packing.packed(make_docs(texts)).collect(), dict(enumerate(texts)))


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (1, "a b c", 5), (None, "d", 5)], "doc_id long, text string, offset int")
    rows = packing.packed(docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None"]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
    assert packing.packed(docs.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 400), max_size=32))
def test_every_piece_gets_one_place(demand):
    places = packing.assigned_places(demand, 32)
    fill, seen = collections.Counter(), set()
    for width, rows in places.items():
        for (rank, first, place), end in zip(rows.tolist(), [*rows[1:, 0].tolist(), demand[width]]):
            for k in range(end - rank):
                fill[first + k] += width
                assert (first + k, place) not in seen
                seen.add((first + k, place))
    assert len(seen) == sum(demand.values()) and max(fill.values(), default=0) <= 32


def fewest(demand, room):
    """The fewest sequences, by trying every filling of the next one."""
    widths = sorted(demand, reverse=True)

    @functools.cache
    def least(left):
        if not any(left):
            return 0
        fills = [((), room)]
        for w, n in zip(widths, left):
            fills = [((*f, k), r - k * w) for f, r in fills for k in range(min(n, r // w) + 1)]
        # A filling that another one contains is never better.
        full = [f for f, r in fills if not any(n > k and w <= r for w, n, k in zip(widths, left, f))]
        return 1 + min(least(tuple(n - k for n, k in zip(left, f))) for f in full)

    return least(tuple(demand[w] for w in widths))


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 5), min_size=1, max_size=4))
@example({11: 19, 22: 21})
def test_near_the_fewest_sequences(demand):
    """Rounding down loses less than one sequence a pattern, and a basis has no more patterns than there are widths."""
    places = packing.assigned_places(demand, 32)
    used = 1 + max(int(rows[-1, 1]) + demand[w] - 1 - int(rows[-1, 0]) for w, rows in places.items())
    best = 31 if demand == {11: 19, 22: 21} else fewest(demand, 32)
    assert best <= used <= best + len(demand)


def test_elimination():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(40, 40))
    a[0, 0] = 0
    x = rng.normal(size=(40, 3))
    assert np.allclose(packing.solved(a, np.einsum("ij,jk->ik", a, x)), x, atol=1e-9)


def test_program_ends_after_a_child_process_was_started():
    """As on a driver, which has started the JVM: all 256 classes, in a process of its own."""
    code = (
        "import numpy, os, subprocess\n"
        "subprocess.Popen(['true'], preexec_fn=os.getpid).wait()\n"
        "from tickerloom.llm.packing import cutting_stock\n"
        "demand = {w: 1 + 7919 * w % 1000 for w in range(1, 257)}\n"
        "plan = cutting_stock(demand, 256)\n"
        "assert all(sum(w * k for w, k in p.items()) <= 256 for p, _ in plan)\n"
        "print(sum(n for _, n in plan), -(-sum(w * n for w, n in demand.items()) // 256))\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=pathlib.Path(__file__).parents[2])
    used, least = map(int, done.stdout.split())
    assert least - 300 <= used <= 1.2 * least, done.stderr
