"""Stacked logistic models against one-at-a-time fits."""

import datetime as dt
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from tickerloom.functions.linear import solved, times
from tickerloom.operators import logistic, models

COLUMNS = ["a", "b", "c", "d", "e"]


def table(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)) * [1, 10, 0.1, 1, 1] + [0, 5, 0, 0, 0]
    x[:, 4] = 2 * x[:, 0] + 1  # collinear
    y = (x[:, 0] + 0.1 * x[:, 1] + 0.7 * rng.normal(size=n) > 0.5).astype(int)
    day = dt.date(2020, 1, 1)
    rows = [("AB"[i % 2], day + dt.timedelta(days=i), int(y[i]), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, date date, target int, " + ", ".join(f"{k} double" for k in COLUMNS)), x, y


def newton(x, y, ridge):
    z, beta = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    hold = np.append(np.full(x.shape[1], ridge), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-times(z, beta)))
        curve = times((z * (p * (1 - p))[:, None]).T, z) / len(z) + np.diag(hold + 1e-12)
        beta = beta + solved(curve, times(z.T, y - p) / len(z) - hold * beta)
    return beta


def test_all_sets_in_the_same_passes_equal_single_fits(spark):
    df, x, y = table(spark)
    rows = df.select(F.col("target").cast("double").alias("y"), F.array(*COLUMNS).alias("x")).repartition(7)
    center, scale = logistic.scales(rows, 5)
    assert np.allclose(center, x.mean(axis=0)) and np.allclose(scale, x.std(axis=0, ddof=1))
    sets = [np.array(s) for s in ([0], [1, 2], [0, 1, 2, 3], [0, 1, 4])]
    betas = logistic.fit_sets(rows, sets, center, scale)
    for own, beta in zip(sets, betas):
        assert np.abs(beta - newton((x[:, own] - center[own]) / scale[own], y, logistic.RIDGE)).max() < 1e-6
    scores = logistic.set_scores(rows, ["y"], sets, betas, center, scale)
    got = {r["model"]: r["s"] for r in scores.groupBy("model").agg(F.sum("score").alias("s")).collect()}
    z = (x[:, sets[2]] - center[sets[2]]) / scale[sets[2]]
    assert abs(got[2] - (times(z, betas[2][:-1]) + betas[2][-1]).sum()) < 1e-6
    assert [len(b) for b in logistic.fit_sets(rows.limit(0), sets, center, scale)] == [2, 3, 5, 4]


def test_separable_and_constant_labels_end(spark):
    rows = [(float(v > 0), [float(v), 0.0]) for v in range(-20, 20)]
    df = spark.createDataFrame(rows, "y double, x array<double>")
    center, scale = logistic.scales(df, 2)
    for part in (df, df.filter("y = 1")):
        beta = logistic.fit_sets(part, [np.array([0, 1])], center, scale)[0]
        assert np.isfinite(beta).all()


def test_ablation(spark, tmp_path):
    df, _, _ = table(spark)
    groups = {"one": ["a", "missing"], "two": ["b"], "none": ["gone"], "noise": ["c", "d"]}
    combinations = {"all": ["one", "two", "noise"], "one": ["one"], "noise": ["noise"], "nothing": ["none"]}
    got = models.run_ablation(df, groups, combinations, str(tmp_path / "rows")).collect()
    assert {(r.combination, r.n_features) for r in got} == {("all", 4), ("one", 1), ("noise", 2)}
    assert [r.val_auc for r in got] == sorted((r.val_auc for r in got), reverse=True) and got[-1].combination == "noise"
    assert {(r.train_rows, r.val_rows) for r in got} == {(360, 40)} and got[0].train_auc > 0.8


def test_stack_equals_single_models():
    """Symbols of different lengths, of one class and without validation rows, alone and together; in a process of its
    own, as it runs in the tasks' processes."""
    code = """
import numpy as np
from tickerloom.operators.logistic import fit_stack
rng = np.random.default_rng(1)
sizes = [60, 200, 35, 50, 40]
x = np.zeros((5, 200, 4)); y = np.zeros((5, 200)); train = np.zeros((5, 200), bool); valid = np.zeros((5, 200), bool)
for k, n in enumerate(sizes):
    x[k, :n] = rng.normal(size=(n, 4))
    y[k, :n] = x[k, :n, 0] + rng.normal(size=n) > 0 if k != 3 else 1
    train[k, : n - 10] = True; valid[k, n - 10 : n] = k != 4
    if k == 4: train[k, :n] = True
beta, count = fit_stack(x, y, train, valid)
assert np.isfinite(beta).all() and (count >= 3).all()
for k, n in enumerate(sizes):
    one, c = fit_stack(x[k : k + 1, :n], y[k : k + 1, :n], train[k : k + 1, :n], valid[k : k + 1, :n])
    assert np.allclose(one[0], beta[k], atol=1e-9) and c[0] == count[k]
print("ok")
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=100)
    assert done.stdout.strip() == "ok", done.stderr


def test_symbols_do_not_depend_on_the_stacks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(30):
        for i in range(40 + 7 * k % 50):
            v = rng.normal(size=5)
            rows.append((f"s{k:02d}", dt.date(2020, 1, 1) + dt.timedelta(days=i), int(v[0] > 0), *map(float, v)))
    df = spark.createDataFrame(rows, "symbol string, date date, target int, " + ", ".join(f"{k} double" for k in COLUMNS))
    together = {r.symbol: r for r in models.train_models(df, COLUMNS, F.lit(dt.date(2021, 1, 1))).collect()}
    monkeypatch.setattr(logistic, "STACK_ROWS", 1)
    alone = {r.symbol: r for r in models.train_models(df.repartition(9), COLUMNS, F.lit(dt.date(2021, 1, 1))).collect()}
    assert len(together) == 30 and sum(r.rows for r in together.values()) == len(rows)
    for s, r in together.items():
        assert np.allclose(r.weights, alone[s].weights, atol=1e-8) and r.rows == alone[s].rows


def test_ablation_leaves_no_shuffle_files_and_exchanges_no_features(spark, tmp_path):
    """Its rows are as wide as all features; they are split in the pass that makes them, and scores go some models a time."""
    df, _, _ = table(spark)
    rows, used = models.ablation_rows(df.withColumn("e", F.col("e") + 1), {"one": COLUMNS}, "stratified")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert used == COLUMNS and plan.count("MapInArrow") == 1 and "Window" not in plan
    by_windows, _ = models.ablation_rows(df.withColumn("e", F.col("e") + 1).withColumn("target", F.col("target").cast("smallint")), {"one": COLUMNS})
    assert rows.schema.simpleString() == by_windows.schema.simpleString() and rows.exceptAll(by_windows).isEmpty() and by_windows.exceptAll(rows).isEmpty()
    groups = {n: [n] for n in COLUMNS}
    every = {n: [n] for n in COLUMNS} | {"all": COLUMNS}
    got = {r.combination: r for r in models.run_ablation(df, groups, every, str(tmp_path / "rows")).collect()}
    assert got.keys() == every.keys() and got["a"].val_auc > got["d"].val_auc
    assert {(r.train_rows, r.val_rows) for r in got.values()} == {(360, 40)}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
