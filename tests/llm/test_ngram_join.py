import collections
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from hypothesis import given, settings
from hypothesis import strategies as st

from tickerloom.llm import words
from tickerloom.llm.components import connected_components
from tickerloom.llm.ngram_join import KEY, _count, _Dealer, _gather, _may_link, _pack, _prefixes, _unpack, ngram_components


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, size=5):
    w = tokens(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(texts):
    """Components by comparing all pairs."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def got(docs, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(docs, **options).collect()}


def copies(seed=3):
    """A base with hundreds of copies that differ more and more, a common passage, chains of copies, edge cases."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    texts = [" ".join(base)]
    for k in range(160):
        copy = list(base)
        for _ in range(k % 9):
            copy[rng.randrange(len(copy))] = f"x{k}_{rng.randrange(9)}"
        texts.append(" ".join(copy))
    chain = list(base)
    for k in range(12):
        chain = chain[3:] + [f"c{k}", f"d{k}", f"e{k}"]
        texts.append(" ".join(chain))
    passage = [rng.choice(vocabulary) for _ in range(40)]
    for k in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        texts.append(" ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :]))
    edge = ["", None, " \t\n", "one", "ONE", "one two three", "one  two\tthree", "a b c d e", "A B C D E", "é b c d e", "É b c d e"]
    return texts + edge + edge + [" ".join(rng.choice(vocabulary) for _ in range(4000))]


def test_equals_brute_force(make_docs):
    texts = copies()
    assert got(make_docs(texts)) == brute(texts)


def test_buckets_do_not_matter(make_docs):
    texts = copies(5)
    assert got(make_docs(texts), buckets=3) == got(make_docs(texts), buckets=64) == brute(texts)


def test_a_set_in_a_bucket_takes_nine_bytes():
    """With many buckets most sets have one item in one, so what goes with each set is most of what is shuffled."""
    owner, key = np.repeat(np.array([3, 5, 2**63 + 1], np.uint64), [1, 700, 255]), np.arange(956, dtype=np.uint64) << np.uint64(30)
    seen = (np.arange(956) % 64).astype(np.uint8)
    blob = _pack(owner, key, seen)
    assert len(blob) == 16 + (1 + 3 + 1) * 9 + 956 * (KEY + 1)
    assert all((a == b).all() for a, b in zip(_unpack(blob, np.uint8), (owner, key, seen)))
    empty = _pack(owner[:0], key[:0])
    assert [len(x) for x in _unpack(empty)[:2]] == [0, 0]


def test_a_bucket_sends_one_row_to_each_other():
    """Many near copies share shingles of every bucket; rows are by pairs of buckets, not by pieces of them, too."""
    rng, bits = random.Random(1), 3
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(base[: rng.randrange(200, 300)] + [f"x{k}"]) for k in range(200)]
    dealer = _Dealer(bits, 5)
    dealer.add(pa.array(range(200)), pa.array(texts))
    dealt = pa.Table.from_batches([dealer.flush()])
    assert dealt.num_rows <= 2 << bits
    counted = [_count(bits)(dealt.filter(pc.equal(dealt.column("bucket"), b))) for b in range(1 << bits)]
    assert all(t.num_rows <= (1 << bits) + 1 for t in counted)
    counted = pa.concat_tables(counted)
    found = [_gather(bits, 75)(counted.filter(pc.equal(counted.column("home"), h))) for h in range(1 << bits)]
    rows = pa.concat_tables(found).to_pylist()
    assert sorted((r["id"], r["n"]) for r in rows if r["shared"] is None) == [(k, len(shingles(t))) for k, t in enumerate(texts)]
    names = {r["set"]: r["id"] for r in rows if r["shared"] is None}
    every = collections.Counter(x for s in map(shingles, {t: t for t in texts}) for x in s)
    want = {k: sum(every[x] > 1 for x in shingles(t)) for k, t in enumerate(texts)}
    assert {names[r["set"]]: len(r["shared"]) // 8 for r in rows if r["shared"] is not None} == want


def test_prefix_rows_are_five_numbers(spark):
    """The suffix filter's counts go with every prefix shingle through each join; more than 255 in a part are left out."""
    sets = [(1, 40, np.arange(0, 320, 8, dtype=np.uint64)), (2, 3000, np.arange(3000, dtype=np.uint64))]
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([[1, 2], [40, 3000], [k.tobytes() for *_, k in sets]], (pa.int64(), pa.int64(), pa.binary()))], names=["set", "n", "shared"])
    first, second = _prefixes(75)(iter([batch]))
    assert first.schema.types == [pa.int64()] * 5 and set(first.column("parts").to_pylist()) == {40}
    assert set(second.column("parts").to_pylist()) == {None}
    rows = spark.createDataFrame([(40, 0, 40), (39, 0, 39 << 56), (40, 0, None), (20, 0, 40 << 8)], "n long, at long, parts long")
    x, y = rows.where("n = 40 and parts = 40").alias("x"), rows.alias("y")
    met = x.join(y, _may_link("x", "y", 75)).select("y.n", "y.parts").collect()
    assert sorted(map(tuple, met), key=str) == [(40, 40), (40, None)]


def test_large_sets_that_differ_little(make_docs):
    long = [f"w{k}" for k in range(4000)]
    texts = [" ".join(long), " ".join(long[:2000] + ["x"] + long[2000:]), " ".join(long[1500:]), " ".join(long[:3600])]
    assert got(make_docs(texts)) == brute(texts)


def test_given_documents(sample):
    rows = {r["doc_id"]: r["text"] for r in sample("documents").collect()}
    ids = sorted(rows)
    want = {ids[i]: (n, ids[c]) for i, (n, c) in brute([rows[i] for i in ids]).items()}
    assert got(sample("documents")) == want


def test_nulls_repeats_and_other_columns(spark):
    rows = [(5, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, None), (None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, component_id int, set int")
    out = sorted(map(tuple, ngram_components(docs).collect()), key=str)
    assert out == sorted([(5, 2, 3), (None, 2, None), (3, 2, 3), (3, 2, 3), (9, 0, 9), (None, 0, None)], key=str)
    assert ngram_components(docs.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 400)] + [(7, 7), (300, 301), (5, 6), (6, 5)]
    out = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in (7, *range(200, 400))}, 5: 5, 6: 5}
    assert {r["node"]: r["component"] for r in out} == want and len(out) == len(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x0b\x85 ", max_size=30)), max_size=8))
def test_words_as_a_pattern_finds_them(texts):
    array = pa.array(texts, pa.string())
    data, offsets = words.text_bytes(array)
    starts, ends, before = words.word_spans(data, offsets)
    found = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    for i, t in enumerate(texts):
        assert found[before[i] : before[i + 1]] == re.findall(r"[^\x20\x09-\x0D]+", t or "")
    hashes = words.word_hashes(data, starts, ends)
    same = collections.defaultdict(set)
    for w, h in zip(found, hashes.tolist()):
        same[re.sub("[A-Z]", lambda m: m[0].lower(), w)].add(h)
    assert all(len(h) == 1 for h in same.values()) and len({min(h) for h in same.values()}) == len(same)
    keys, at = words.shingle_sets(array)
    assert np.diff(at).tolist() == [len(shingles(t)) for t in texts]
