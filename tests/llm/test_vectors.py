import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import vantage, voronoi

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, k, every, scale=None, zero=True):
    usable = [(i, [float(np.float32(v)) for v in e]) for i, e in rows if e is not None and all(v is not None and np.isfinite(v) for v in e)]
    usable = [(i, np.floor(scale * np.array(e)) if scale else np.array(e)) for i, e in usable if zero or any(e)]
    out = {}
    for q, x in usable:
        if q % every == 0:
            found = sorted((-float(x @ y), i) for i, y in usable if i != q)[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def clusters(n=600, d=8, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    x = (centres[rng.integers(0, 6, n)] + 0.15 * rng.normal(size=(n, d))).astype(np.float32)
    x[: n // 3] = x[0]  # a third is one vector
    rows = [(int(i), [float(v) for v in e]) for i, e in zip(rng.permutation(n), x)]
    bad = [None, [None] * d, [float("nan")] + [0.0] * (d - 1), [float("inf")] * d, [0.0] * d, [0.0] * d]
    return rows + [(n + i, e) for i, e in enumerate(bad)]


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1) for i, e in rows], SCHEMA)


@pytest.mark.parametrize("block, group", [(4096, 1024), (64, 16)])
def test_voronoi_equals_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(voronoi, "BLOCK", block)
    monkeypatch.setattr(voronoi, "GROUP", group)
    rows = clusters()
    assert got(voronoi.voronoi_top_k(table(spark, rows), 5, F.col("vec_id") % 7 == 0)) == brute(rows, 5, 7, 256.0)


def test_voronoi_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.0, 0.0]), (51, [-1.0, 0.5]), (52, [1.0, 2.0, 3.0])]
    assert got(voronoi.voronoi_top_k(table(spark, rows), 5, F.col("vec_id") % 50 == 0)) == brute(rows[:3], 5, 50, 256.0)
    for few in (rows[:1], rows[2:3], [(1, None)], []):
        assert got(voronoi.voronoi_top_k(table(spark, few), 5, F.col("vec_id") % 50 == 0)) == {}


def test_bounds_leave_out_far_rows(spark):
    """With tight clusters, a group of queries gets less than all rows."""
    rng = np.random.default_rng(0)
    pivots = np.eye(4) * 10
    near = {j: [0.1] * 6 for j in range(4)}
    plan = voronoi._plan(pivots, near, {j: 100 for j in range(4)}, {0: (1500, 0.2), 2: (10, 0.2)}, 5, 1e-6)
    assert [p[1] for p in plan] == [2, 1]
    for cells, _, _, low, high in plan:
        for j in range(4):
            assert (low[j] <= 0.1 <= high[j]) == (j in cells)
    assert rng is not None


@pytest.mark.parametrize("factor", [1.0, vantage.FACTOR])
def test_vantage_points(spark, monkeypatch, factor):
    monkeypatch.setattr(vantage, "SHARD", 150)
    monkeypatch.setattr(vantage, "LEAF", 8)
    rows = clusters()
    found = got(vantage.vantage_top_k(table(spark, rows), 20, F.col("vec_id") % 9 == 0, factor=factor))
    want = brute(rows, 20, 9, zero=False)
    assert found.keys() == want.keys()
    ids = dict(rows)
    hits = 0
    for q, best in want.items():
        assert all(abs(s - float(np.dot(np.float32(ids[q]).astype(float), np.float32(ids[i]).astype(float)))) < 1e-12 for i, s in found[q])
        if factor == 1.0:
            assert [i for i, _ in found[q]] == [i for i, _ in best]
        hits += len({i for i, _ in found[q]} & {i for i, _ in best})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_recall_on_given_embeddings(spark, sample):
    rows = [(r["vec_id"], r["embedding"]) for r in sample("embeddings").collect()]
    found = got(vantage.vantage_top_k(sample("embeddings"), 20, F.col("vec_id") % 20 == 0))
    want = brute(rows, 20, 20, zero=False)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_vantage_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.0, 0.0]), (21, [-1.0, 0.5])]
    assert got(vantage.vantage_top_k(table(spark, rows), 20, F.col("vec_id") % 20 == 0)) == {0: [(21, 0.0)]}
    assert got(vantage.vantage_top_k(table(spark, []), 20, F.col("vec_id") % 20 == 0)) == {}
