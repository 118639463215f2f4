from fractions import Fraction

from tickerloom.llm.mixing import mix_rows, mixed, water_fill


def by_rounds(sizes, weights, epochs):
    """Water-filling as told: share by weight, clamp, share the excess again."""
    total, capped = Fraction(sum(sizes)), set()
    while True:
        left = total - sum(epochs * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        target = [Fraction(epochs * s) if i in capped else left * weights[i] / weight for i, s in enumerate(sizes)]
        over = {i for i, t in enumerate(target) if t > epochs * sizes[i]}
        if not over - capped:
            return target
        capped |= over


def test_targets_equal_the_rounds():
    for sizes in ([10], [5, 5, 5], [1, 100, 1000], [1000, 1, 1, 500, 3, 0], [0, 0, 9], [7] * 9):
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        got, want = water_fill(sizes, weights, 3), by_rounds(sizes, weights, 3)
        assert all(abs(g - w) < 1e-9 * (1 + w) for g, w in zip(got, want))
        assert abs(sum(got) - sum(sizes)) < 1e-6
    assert water_fill([], [], 3) == [] and water_fill([0, 0], [5, 2], 3) == [0.0, 0.0]


def rows_of(sizes):
    out = []
    for source, n, each in sizes:
        out += [(" ".join(f"w{i}" for i in range(each + k % 3)), "en", source) for k in range(n)]
    return out


def test_taken_words_meet_the_targets(make_docs):
    docs = make_docs(rows_of([("b", 40, 10), ("a", 5, 3), (None, 30, 7), ("Z", 8, 50)]) + ["", None])
    rows = mixed(docs).collect()
    assert len(rows) == docs.count()
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken, target, size = {}, {}, {}
    for r in rows:
        s = sources[r["doc_id"]]
        taken[s] = taken.get(s, 0) + r["taken"]
        size[s] = size.get(s, 0) + r["size"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] >= r["size"]
    order = sorted(target, key=lambda s: (s is None, s or ""))
    want = by_rounds([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3)
    for s, w in zip(order, want):
        assert abs(target[s] - w) < 1e-6 and abs(taken[s] - w) <= 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixed(docs.repartition(3)).collect()))


def test_rows_of_the_mix_hold_the_taken_words(make_docs):
    docs = make_docs(rows_of([("b", 12, 10), ("a", 5, 3), (None, 9, 7)]) + ["", None])
    got = {}
    for r in mix_rows(docs).collect():
        assert r["text"] is None or r["n_chars"] == len(r["text"])
        got.setdefault(r["doc_id"], []).append(len((r["text"] or "").split()))
    for r in mixed(docs).collect():
        assert sum(got.get(r["doc_id"], [])) == r["taken"]
        if r["size"] == 0:
            assert got[r["doc_id"]] == [0]
    assert mix_rows(docs).columns == docs.columns


def test_repeated_rows_nulls_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 9), (1, "a b", "s", 9), (None, "c d e", None, 9), (2, None, "s", 9)], "doc_id long, text string, source string, size int")
    rows = mixed(docs).collect()
    assert len(rows) == 4 and len({r["taken"] for r in rows if r["doc_id"] == 1}) == 1
    assert mixed(docs.limit(0)).count() == 0 and mix_rows(docs.limit(0)).count() == 0
