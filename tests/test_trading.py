"""Macro joins, evaluation, models, ledger and streams."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import evaluation, explore, logistic, macro, matching, models, upsert
from tickerloom.plans import features, trading
from tickerloom.sources import bars as src
from tickerloom.streaming import news as stream

c = F.col
D = dt.date


def test_macro_value_of_a_day_without_trading(spark):
    bars = spark.createDataFrame([("A", D(2024, 1, 5), 1.0), ("A", D(2024, 1, 8), 1.0)], "symbol string, date date, close double")
    wide = spark.createDataFrame([(D(2024, 1, 5), 10.0), (D(2024, 1, 7), 20.0)], "date date, rate double")
    read = lambda df: [r.rate for r in df.orderBy("date").collect()]
    assert read(macro.join_macro(bars, wide)) == [10.0, 10.0]
    assert read(macro.join_macro(bars, wide, mode="asof")) == [10.0, 20.0]
    late = wide.filter(c("date") > D(2024, 1, 5)).withColumn("date", F.lit(D(2024, 1, 8)))
    assert read(macro.join_macro(bars, late)) == [None, 20.0]
    assert read(macro.join_macro(bars, late, backfill=True)) == [20.0, 20.0]


def test_resample_and_local_dates(spark, make_bars):
    bars = make_bars([1, 2, 3, 4, 5, 6]).withColumn("x", F.when(c("close") < 3, c("close")))
    got = src.resample_last(bars, "W", columns=["close", "x"]).orderBy("period").collect()
    assert [(r.period, r.close, r.x) for r in got] == [(D(2020, 1, 5), 5.0, 2.0), (D(2020, 1, 12), 6.0, None)]
    ts = spark.sql("SELECT timestamp'2024-03-01 22:00:00' AS t").select(src.local_date(c("t")).alias("d"))
    assert ts.first().d == D(2024, 3, 2)


def test_auc(spark):
    rng = np.random.default_rng(1)
    rows = [("g%d" % (i % 3), int(y), float(s)) for i, (y, s) in enumerate(zip(rng.integers(0, 2, 900), rng.integers(0, 40, 900) / 7))]
    rows += [("one", 1, 0.3), ("one", 1, 0.4)]
    df = spark.createDataFrame(rows, "g string, y int, s double")

    def brute(sub):
        pos, neg = [s for _, y, s in sub if y], [s for _, y, s in sub if not y]
        if not pos or not neg:
            return 0.5
        return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))

    got = {r.g: r.auc for r in evaluation.roc_auc(df, "y", "s", ["g"]).collect()}
    assert got == {g: pytest.approx(brute([r for r in rows if r[0] == g])) for g in {r[0] for r in rows}}
    assert evaluation.roc_auc(df, "y", "s").first().auc == pytest.approx(brute(rows))
    y, s = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    assert logistic.auc(y, s) == pytest.approx(brute(rows))


def test_auc_orders_a_group_once_and_joins_nothing(spark):
    """Groups keep no table of their distinct scores beside the order; ranges of scores are put together from their sums."""
    rows = [("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, -1.0), ("a", 0, None), ("a", None, 9.0), ("b", 0, 2.0), ("b", 1, 1e9), ("b", 0, -3.0), ("b", 1, 2.0)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    small, wide, whole = (evaluation.roc_auc(df, "y", "s", by, w) for by, w in ((["g"], False), (["g"], True), (None, False)))
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (small, wide, whole)]
    assert not any("Join" in x for x in plans) and "keys=[g" in plans[0] and ", _s#" not in plans[0].split("HashAggregate(keys")[-1].split("]")[0]
    assert all(line.count("_s#") == 0 for line in plans[0].splitlines() if "HashAggregate" in line)
    assert {tuple(r) for r in small.collect()} == {("a", 2, 2, 0.625), ("b", 2, 2, 0.875)}
    assert {tuple(r) for r in wide.collect()} == {("a", 2, 1, 0.25), ("b", 2, 2, 0.875)}  # rows without a score are left out
    # 12 pairs of 4 with 3: -1 wins over -3; each 0.5 over -3 with a tie; 2 over -3, 0.5 with a tie; 1e9 over all.
    assert tuple(whole.first()) == (4, 3, (1 + 1.5 + 2.5 + 3) / 12)



def test_report_against_counts(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (1, 0), (2, 0)], "y int, p int")
    rep = {r.label: (r.precision, r.recall, r.support) for r in evaluation.class_report(df, "y", "p").collect()}
    assert rep == {0: (pytest.approx(1 / 3), 0.5, 2), 1: (pytest.approx(2 / 3), pytest.approx(2 / 3), 3), 2: (0.0, 0.0, 1)}
    assert evaluation.weighted_report(df, "y", "p").first().accuracy == pytest.approx(0.5)


def learnable(spark, symbols=("A", "B"), n=200):
    rng = np.random.default_rng(2)
    rows = []
    for s in symbols:
        x = rng.normal(size=(n, 5))
        y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
        rows += [(s, D(2020, 1, 1) + dt.timedelta(days=i), int(y[i]), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, date date, target int, a double, b double, c double, d double, e double")


@pytest.mark.parametrize("split", ["time", "stratified"])
def test_models_learn_and_score(spark, split):
    df = learnable(spark)
    columns = ["a", "b", "c", "d", "e", "absent"]
    fitted = models.train_models(df, columns, F.lit(D(2020, 9, 1)), split=split).persist()
    assert [r.val_auc > 0.85 for r in fitted.collect()] == [True, True]
    scored = models.score_latest(df, fitted, D(2020, 9, 1)).collect()
    assert {r.code for r in scored} == {"A", "B"} and all(0 <= r.probability <= 1 for r in scored)
    r = fitted.filter("symbol = 'A'").first()
    last = df.filter("symbol = 'A'").orderBy(c("date").desc()).first()
    z = sum((last[n] - m) / s * w for n, m, s, w in zip("abcde", r.center, r.scale, r.weights)) + r.bias
    assert [x.probability for x in scored if x.code == "A"] == [pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)]
    fitted.unpersist()


def test_a_row_is_scored_by_the_columns_of_its_model(spark):
    df = learnable(spark)
    rows = [("A", ["e", "gone", "a"], [0.1, 5.0, 0.2], [2.0, 2.0, 4.0], [1.5, 3.0, -2.0], 0.25, 0.6), ("B", ["b"], [0.0], [1.0], [1.0], 0.0, 0.7)]
    fitted = spark.createDataFrame(
        rows, "symbol string, feature_cols array<string>, center array<double>, scale array<double>, weights array<double>, bias double, val_auc double"
    )
    last = {s: df.filter(c("symbol") == s).orderBy(c("date").desc()).first() for s in "AB"}
    z = {
        "A": (last["A"].e - 0.1) / 2 * 1.5 + (0 - 5) / 2 * 3 + (last["A"].a - 0.2) / 4 * -2 + 0.25,
        "B": last["B"].b,
    }
    for table in (df, df.withColumn("more", F.lit(9.0)), df.select("e", "d", "symbol", "date", "c", "b", "a", "target")):
        got = {r.code: r.probability for r in models.score_latest(table, fitted, D(2020, 9, 1)).collect()}
        assert got == {s: pytest.approx(1 / (1 + np.exp(-v)), abs=1e-4) for s, v in z.items()}
    without = models.score_latest(df.drop("b"), fitted, D(2020, 9, 1)).collect()
    assert {r.code: r.probability for r in without}["B"] == 0.5


def test_short_histories_are_skipped(spark):
    df = learnable(spark).filter((c("symbol") == "A") | (c("date") < D(2020, 3, 1)))
    company = spark.createDataFrame([(1, "A", "a"), (2, "B", "b"), (3, "C", "c")], "company_id bigint, code string, name string")
    none = spark.createDataFrame([], "symbol string, trained_at timestamp")
    fitted, status = trading.weekly_training(df, company, none, D(2020, 9, 1), min_rows=100, columns=list("abcde"))
    assert [r.symbol for r in fitted.collect()] == ["A"]
    assert {r.symbol: r.status for r in status.collect()} == {"A": "trained", "B": "skipped", "C": "skipped"}
    known = spark.createDataFrame([(s, ["a"], [0.0], [1.0], [1.0], 0.0, 0.5) for s in "AB"], "symbol string, feature_cols array<string>, center array<double>, scale array<double>, weights array<double>, bias double, val_auc double")
    empty = spark.createDataFrame([], "company_id bigint, prediction_date date, signal int, probability double, model_version string, model_auc double, created_at timestamp")
    got = trading.daily_predictions(df, known, company, empty, D(2020, 9, 1), min_rows=100).collect()
    assert [r.company_id for r in got] == [1]


def test_too_few_features_and_missing_models(spark):
    none = models.train_models(learnable(spark), ["a", "b"], F.lit(D(2020, 9, 1)))
    assert none.count() == 0
    with pytest.raises(models.NoModelsError):
        models.require_models(none)


def test_retrain_policy(spark):
    company = spark.createDataFrame([(1, "A", "a"), (2, "B", "b"), (3, "C", "c")], "company_id bigint, code string, name string")
    stored = spark.createDataFrame(
        [("A", dt.datetime(2024, 1, 8)), ("B", dt.datetime(2024, 1, 1))], "symbol string, trained_at timestamp"
    )
    status = {r.symbol: r.status for r in models.retrain_status(company, stored, D(2024, 1, 8)).collect()}
    assert status == {"A": "not_needed", "B": "train", "C": "train"}
    forced = models.retrain_status(company, stored, D(2024, 1, 8), force=True)
    assert forced.filter("status = 'train'").count() == 3


def test_pipeline_keeps_complete_long_histories(spark, make_bars):
    rng = np.random.default_rng(3)
    walk = lambda n: list(100 + rng.normal(0, 1, n).cumsum())
    bars = make_bars({"LONG": walk(400), "SHORT": walk(250)})
    bars = bars.withColumns({"high": c("close") + F.rand(1), "low": c("close") - F.rand(2), "volume": F.rand(3) * 100 + 1})
    out = features.build_features(bars, min_rows=100)
    names = [n for n in features.feature_columns() if n in out.columns]
    assert len(names) == 65 == len(features.feature_columns())
    rows = out.groupBy("symbol").count().collect()
    assert [(r.symbol, r["count"]) for r in rows] == [("LONG", 400 - 251)]
    assert out.select(*[F.count_if(c(f"`{n}`").isNull()).alias(n) for n in names]).first().asDict() == dict.fromkeys(names, 0)


# -- ledger -----------------------------------------------------------------------------


def test_intents_of_a_day_with_prices(spark, make_bars):
    day = D(2020, 1, 8)
    bars = make_bars({"A": [10, 20, 30], "B": [5, 5, 5]})
    company = spark.createDataFrame([(1, "A", "a"), (2, "B", "b"), (3, "C", "c")], "company_id bigint, code string, name string")
    prediction = spark.createDataFrame(
        [(1, day, 1, 0.6, "nn_v1", None), (2, day, 2, 0.7, "nn_v1", None), (3, day, -1, 0.4, "nn_v1", None), (2, D(2020, 1, 2), -2, 0.1, "nn_v1", None)],
        "company_id bigint, prediction_date date, signal int, probability double, model_version string, model_auc double",
    )
    got = trading.daily_intents(prediction, company, bars, day).orderBy("seq").collect()
    # A price of five days ago still counts.
    assert [(r.symbol, r.action, r.price) for r in got] == [("C.IS", "sell", None), ("B.IS", "buy", 5.0), ("A.IS", "buy", 30.0)]
    assert all(r.price is None for r in trading.daily_intents(prediction.withColumn("prediction_date", F.lit(D(2020, 1, 9))), company, bars, D(2020, 1, 9)).collect())


# -- streams --------------------------------------------------------------------------------

def test_stream_equals_batch_and_drops_late_articles(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 20)
    batches = [
        [("u1", t0, "A", "p", "x", 1.0), ("u1", t0, "A", "p", "x", 9.0), (None, t0, "B", "p", "x", 2.0)],
        [("u1", t0 + dt.timedelta(hours=2), "A", "p", "x", 5.0), ("u2", t0 + dt.timedelta(days=1), "A", "p", "x", 3.0)],
        [("old", t0 - dt.timedelta(days=30), "A", "p", "x", 7.0), ("", t0, "B", "p", "x", 2.0)],
    ]
    seen = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, stream.ARTICLES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = stream.article_stream(spark, str(tmp_path / "in"))
        query = stream.start_ingest(
            stream.deduplicated(source), lambda df, n: seen.extend(r.url for r in df.collect()), str(tmp_path / "state"), every=None
        )
        query.awaitTermination()
    assert sorted(seen) == ["", "u1", "u2"]


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 40)) @ rng.normal(size=(40, 90)) + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 3.0
    frame = pd.DataFrame(x, columns=[f"f{i}" for i in range(90)])
    want = frame.corr()
    got = explore.correlations(spark.createDataFrame(frame).repartition(5), list(frame.columns)).collect()
    assert len(got) == 90 * 89 / 2
    for r in got:
        w = want.loc[r.a, r.b]
        assert (r["corr"] is None and np.isnan(w)) or r["corr"] == pytest.approx(w, abs=1e-6)


def test_plans_start_no_job(spark, tmp_path, make_bars):
    make_bars({"A": list(range(1, 60)), "B": list(range(2, 61))}).write.parquet(str(tmp_path / "bars"))
    bars = spark.read.parquet(str(tmp_path / "bars"))
    articles = spark.createDataFrame([(1, 1, D(2020, 1, 1), "p", "AAA text")], "seq int, news_id int, news_date date, provider string, content string")
    listing = spark.createDataFrame([("AAA", "Aaa Bbb")], "code string, name string")
    company = spark.createDataFrame([(1, "A", "a")], "company_id bigint, code string, name string")
    incoming = spark.createDataFrame([(1, "N", "n")], "seq int, code string, name string")
    spark.sparkContext.setJobGroup("plans", "building only")
    try:
        explore.describe(bars, ["close", "volume"])
        explore.correlations(bars, ["close", "volume"])
        evaluation.roc_auc(bars.withColumn("y", F.lit(1)), "y", "close")
        features.build_features(bars, min_rows=1)
        matching.match_articles(articles, listing)
        upsert.upsert_company(company, incoming)
        upsert.drop_stored_texts(articles)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plans")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_both_probabilities(spark):
    df = learnable(spark)
    columns = list("abcde")
    rows = models._pooled_rows(evaluation.time_split(df), columns)
    scored = models.pooled_models(columns)["logistic"].fit(rows).transform(rows)
    got = models.both_probabilities(scored).select("p_down", "p_up", "prediction").collect()
    assert all(abs(r.p_down + r.p_up - 1) < 1e-9 and (r.p_up > 0.5) == (r.prediction == 1) for r in got) and len(got) == 400


def test_summaries(spark, make_bars):
    bars = make_bars([1, 2, 3, 4])
    row = {r["column"]: r for r in explore.describe(bars, ["close"]).collect()}["close"]
    assert (row["count"], row["mean"], row["p25"], row["max"]) == (4, 2.5, 1.75, 4.0)
    kept = explore.keep_last(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, seq int, v string"), ["k"], "seq")
    assert kept.first().v == "b"


def test_polynomial_model_has_cubic_terms(spark):
    """A target that only a product of three columns tells."""
    signs = [(x, y, z) for x in (-1.0, 1.0) for y in (-1.0, 1.0) for z in (-1.0, 1.0)]
    rows = [(f"{i}", None, float(x * y * z > 0), False, x, y, z) for i, (x, y, z) in enumerate(signs * 20)]
    rows += [(f"v{i}", None, float(x * y * z > 0), True, x, y, z) for i, (x, y, z) in enumerate(signs * 5)]
    table = spark.createDataFrame(rows, "symbol string, date date, target double, is_valid boolean, f0 double, f1 double, f2 double")
    assert min(models.fit_and_score(models.pooled_models(["a", "b", "c"])["poly_svm"], table)) > 0.99


def test_quantiles_order_only_values_near_them(spark):
    """From plain rows, with repeated, negative and zero values; the same as numpy's."""
    import numpy as np

    from tickerloom.operators import ranks

    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(0, 100, 501), "b": np.repeat([-1.0, 0.0, 2.5], [3, 4, 6]), "c": np.array([7.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "g string, _x double")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r[0]: r[1:] for r in ranks.quantiles(df, "g", shares).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        assert np.allclose(got[k], np.quantile(v, shares), rtol=1e-12, atol=1e-12)


def test_correlations_read_the_rows_once(spark, tmp_path):
    """The rows may be costly features; a constant and an offset leave the digits alone, a pair without rows stays."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=3000)
    frame = pd.DataFrame({"a": a + 1e8, "b": a + rng.normal(size=3000), "k": 0.1})
    frame.to_parquet(tmp_path / "f.parquet")
    rows = spark.read.parquet(str(tmp_path / "f.parquet")).repartition(7).withColumn("e", F.lit(None).cast("double"))
    out = explore.correlations(rows, ["a", "b", "k", "e"])
    got = {(r.a, r.b): r.corr for r in out.collect()}
    assert abs(got["a", "b"] - np.corrcoef(a, frame.b)[0, 1]) < 1e-7
    assert len(got) == 6 and all(got[p] is None for p in got if p != ("a", "b"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert "scalar-subquery" not in out._jdf.queryExecution().optimizedPlan().toString()
