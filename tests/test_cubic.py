"""The support vector machine over products of columns against explicit products."""

from itertools import combinations_with_replacement

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tickerloom.operators import models
from tickerloom.operators.cubic import CubicSVM, _third

NAMES = ["f0", "f1", "f2", "f3"]


def table(spark, n=600):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 4)) * [1, 30, 0.1, 1] + [5, 0, 0, 0]
    x[:, 3] = 7.0  # constant, so its products are those of the others
    z = (x[:, :3] - x[:, :3].mean(axis=0)) / x[:, :3].std(axis=0)
    y = z[:, 0] * z[:, 1] * z[:, 2] + 0.5 * z[:, 0] ** 2 - z[:, 1] + 0.4 * rng.normal(size=n) > 0
    return spark.createDataFrame([(float(t), *map(float, r)) for t, r in zip(y, x)], "target double, " + ", ".join(f"{k} double" for k in NAMES)), x, 2.0 * y - 1


def hinge(margin, side):
    return np.maximum(0, 1 - side * margin).mean()


def test_margins_are_those_of_explicit_products(spark):
    df, x, side = table(spark)
    model = CubicSVM(NAMES, iterations=60).fit(df.repartition(5))
    z = np.column_stack([np.ones(len(x)), (x - model.center) / model.scale])
    want, seen = np.zeros(len(x)), 0
    pairs = list(zip(*np.triu_indices(5)))
    for i, j, k in combinations_with_replacement(range(5), 3):
        want += model.weights[pairs.index((i, j)), k] * z[:, i] * z[:, j] * z[:, k]
        seen += 1
    assert seen == _third(4).sum() == 35
    got = {r.f1: r.rawPrediction for r in model.transform(df).collect()}
    assert np.allclose([got[v] for v in x[:, 1]], want)
    assert not model.weights[[k for k, p in enumerate(pairs) if 4 in p]].any()


def test_loss_is_no_greater_than_of_expanded_columns(spark):
    df, x, side = table(spark)
    ours = {r.f1: r.rawPrediction for r in CubicSVM(NAMES).fit(df).transform(df).collect()}
    stages = [
        VectorAssembler(inputCols=NAMES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        PolynomialExpansion(degree=3, inputCol="scaled", outputCol="poly"), LinearSVC(featuresCol="poly", labelCol="target", maxIter=100),
    ]
    out = Pipeline(stages=stages).fit(df).transform(df)
    theirs = {r.f1: r.m for r in out.select("f1", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    assert hinge(np.array([ours[v] for v in x[:, 1]]), side) <= hinge(np.array([theirs[v] for v in x[:, 1]]), side) + 0.005


def test_products_are_not_written_down(spark):
    """2,599 terms of 23 columns were a vector a row, held in memory or on disk for all passes."""
    df, *_ = table(spark, 60)
    rows = df.withColumns({"symbol": F.lit("A"), "date": F.lit(None).cast("date"), "is_valid": F.col("f0") > 6})
    out = models.pooled_models(NAMES, iterations=3)["poly_svm"].fit(rows).transform(rows)
    assert set(out.columns) == {*rows.columns, "rawPrediction"}
    assert "poly" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_one_class_and_few_rows_end(spark):
    df, *_ = table(spark, 40)
    for part in (df.filter("target = 1"), df.limit(1), df.limit(0)):
        assert np.isfinite(CubicSVM(NAMES, iterations=5).fit(part).weights).all()
