"""Direction models per symbol: retrain policy, training, scoring, comparison."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom import schemas
from tickerloom.functions.numeric import finite, sigmoid
from tickerloom.functions.scores import signal
from tickerloom.operators import logistic
from tickerloom.operators.cubic import CubicSVM
from tickerloom.operators.evaluation import leaderboard, q, roc_auc, stratified_split, time_split
from tickerloom.operators.stacks import Stack, arrays, fits_stacks, narrowed, over_symbols, tools
from tickerloom.operators.timeseries import last_per_symbol
from tickerloom.session import freed_shuffles

c = F.col

# Age in days after which a model is stale, and fewest features.
RETRAIN_DAYS = 7
MIN_FEATURES = 5
# Models whose scores of all rows are ordered at a time.
SCORED = 4


class NoModelsError(RuntimeError):
    pass


# -- policy -----------------------------------------------------------------------

def retrain_status(
    company: DataFrame, models: DataFrame, as_of: dt.date, force: bool = False, max_age: int = RETRAIN_DAYS
) -> DataFrame:
    """M-4: per symbol ``train`` (no model, stale or forced) or ``not_needed``."""
    known = models.groupBy("symbol").agg(F.max("trained_at").alias("trained_at"))
    age = F.datediff(F.lit(as_of), F.to_date("trained_at"))
    due = F.lit(force) | c("trained_at").isNull() | (age >= max_age)
    return (
        company.select(c("code").alias("symbol"))
        .join(known, "symbol", "left")
        .withColumn("status", F.when(due, "train").otherwise("not_needed"))
    )


def training_status(policy: DataFrame, features: DataFrame, models: DataFrame, min_rows: int) -> DataFrame:
    """M-4: trained, failed, skipped (too few rows) or not_needed per symbol."""
    rows = features.groupBy("symbol").agg(F.count(F.lit(1)).alias("_rows"))
    done = models.select("symbol", F.lit(True).alias("_done"))
    status = (
        F.when(c("status") == "not_needed", "not_needed")
        .when(F.coalesce("_rows", F.lit(0)) < min_rows, "skipped")
        .when(c("_done"), "trained")
        .otherwise("failed")
    )
    return (
        policy.join(rows, "symbol", "left").join(done, "symbol", "left").withColumn("status", status)
        .select("symbol", "status")
    )


def require_models(models: DataFrame, at_least: int = 1) -> int:
    """M-13."""
    n = models.select("symbol").distinct().count()
    if n < at_least:
        raise NoModelsError(f"{n} models found, {at_least} required: run the training first")
    return n


# -- training ------------------------------------------------------------------------

def model_input(df: DataFrame, columns: list[str]) -> Column:
    """P-2, P-4: features as one array; missing columns and values are 0."""
    F, c = tools(df)
    values = [F.coalesce(finite(c(f"`{n}`")), F.lit(0.0)) if n in df.columns else F.lit(0.0) for n in columns]
    return arrays(values, df) if isinstance(df, Stack) else F.array(*values)


def train_models(
    features: DataFrame,
    columns: list[str],
    trained_at: Column,
    split: str = "time",
    valid_share: float = 0.1,
    trainer=logistic.fit_stack,
) -> DataFrame:
    """M-3: one classifier per symbol, trained in parallel, some ten symbols of a task as one stack of matrices.

    ``trainer`` takes such a stack, see ``logistic.fit_stack``. ``split="stratified"`` draws the validation rows at
    random within each class and scales on all rows; the default validates on the last rows and scales on the training
    rows.
    """
    columns = [n for n in columns if n in features.columns]
    if len(columns) < MIN_FEATURES:
        return features.sparkSession.createDataFrame([], schemas.MODEL)

    def rows(df: DataFrame) -> DataFrame:
        df = df.select("symbol", "date", "target", model_input(df, columns).alias("x"))
        return stratified_split(df, ["symbol", "date"], share=valid_share) if split == "stratified" else time_split(df, share=valid_share)

    fitted = logistic.fit_symbols(narrowed(features, ["symbol", "date", "target", *columns]), rows, len(columns), split == "stratified", trainer)
    return fitted.select(
        "symbol", F.array(*[F.lit(n) for n in columns]).alias("feature_cols"), "center", "scale", "weights",
        "bias", "train_auc", "val_auc", "epochs_trained", "rows", trained_at.cast("timestamp").alias("trained_at"),
    )


# -- scoring -----------------------------------------------------------------------------

def probability(features: Column) -> Column:
    """Up-probability from a feature array and the columns of a model row."""
    scaled = F.zip_with(features, F.arrays_zip("center", "scale", "weights"),
                        lambda x, m: (x - m["center"]) / m["scale"] * m["weights"])
    return sigmoid(F.aggregate(scaled, F.lit(0.0), lambda a, v: a + v) + c("bias"))


def score_latest(features: DataFrame, models: DataFrame, as_of: dt.date) -> DataFrame:
    """M-5, P-2: probability and signal of each symbol's last row, for symbols with a model.

    A row is scored by the columns that its own model was trained on, in the
    model's order; columns that the features lack, and missing values, are 0.
    """
    numbers = ("double", "float", "int", "bigint", "smallint", "tinyint")
    keys = ("symbol", "date", "target")
    columns = [n for n, kind in features.dtypes if n not in keys and (kind in numbers or kind.startswith("decimal"))]
    last = last_per_symbol(features.select("symbol", "date", model_input(features, columns).alias("_x")))
    named = F.map_from_arrays(F.array(*[F.lit(n) for n in columns]).cast("array<string>"), "_x")
    x = F.transform("feature_cols", lambda n: F.coalesce(F.try_element_at(c("_named"), n), F.lit(0.0)))
    scored = last.join(models, "symbol").withColumn("_named", named).withColumn("_p", probability(x))
    return scored.select(
        c("symbol").alias("code"),
        F.lit(as_of).alias("prediction_date"),
        signal(c("_p")).alias("signal"),
        F.round("_p", 4).alias("probability"),
        c("val_auc").alias("model_auc"),
    )


# -- pooled models ----------------------------------------------------------------------------

def pooled_models(columns: list[str], rounds: int = 200, iterations: int = 100) -> dict[str, Pipeline]:
    """M-6: the compared families, each on standardized features of all symbols."""

    def pipeline(*stages):
        return Pipeline(
            stages=[
                VectorAssembler(inputCols=[f"f{i}" for i in range(len(columns))], outputCol="raw"),
                StandardScaler(inputCol="raw", outputCol="features", withMean=True),
                *stages,
            ]
        )

    label = {"labelCol": "target"}
    return {
        "logistic": pipeline(LogisticRegression(maxIter=iterations, **label)),
        # A polynomial kernel of the third degree as explicit products of all columns.
        "poly_svm": CubicSVM([f"f{i}" for i in range(len(columns))], iterations=iterations),
        "boosted_trees": pipeline(
            GBTClassifier(maxDepth=3, maxIter=rounds, stepSize=0.05, subsamplingRate=0.8,
                          featureSubsetStrategy="0.8", minInstancesPerNode=5, seed=42, **label)
        ),
        "neural_net": pipeline(
            MultilayerPerceptronClassifier(layers=[len(columns), 16, 8, 2], maxIter=iterations, seed=42, **label)
        ),
    }


def _pooled_rows(features: DataFrame, columns: list[str]) -> DataFrame:
    values = [F.coalesce(finite(q(n)), F.lit(0.0)).alias(f"f{i}") for i, n in enumerate(columns)]
    return features.select("symbol", "date", c("target").cast("double").alias("target"), "is_valid", *values)


def fit_and_score(pipeline: Pipeline, rows: DataFrame) -> tuple[float, float]:
    """Train and validation AUC of a pooled model."""
    model = pipeline.fit(rows.filter(~c("is_valid")))
    auc = BinaryClassificationEvaluator(labelCol="target", rawPredictionCol="rawPrediction")
    return tuple(
        auc.evaluate(model.transform(rows.filter(flag))) for flag in (~c("is_valid"), c("is_valid"))
    )


def compare_models(features: DataFrame, columns: list[str], split: str = "time", **sizes) -> DataFrame:
    """M-6: AUC of each family on the same split."""
    mark = stratified_split(features, ["symbol", "date"]) if split == "stratified" else time_split(features)
    rows = _pooled_rows(mark, columns).persist()
    try:
        results = [(name, *fit_and_score(p, rows)) for name, p in pooled_models(columns, **sizes).items()]
    finally:
        rows.unpersist()
    return features.sparkSession.createDataFrame(results, "model string, train_auc double, val_auc double")


def both_probabilities(scored: DataFrame) -> DataFrame:
    """M-6: probabilities of down and up from a probability vector."""
    p = vector_to_array("probability")
    return scored.withColumns({"p_down": p[0], "p_up": p[1]})


def ablation_rows(features: DataFrame, groups: dict[str, list[str]], split: str = "stratified") -> tuple[DataFrame, list[str]]:
    """Rows (y, is_valid, f0, f1, ...) with all present columns of the groups, and these columns."""
    used = [n for n in dict.fromkeys(n for g in groups.values() for n in g) if n in features.columns]

    def rows(df: DataFrame) -> DataFrame:
        mark = stratified_split(df, ["symbol", "date"]) if split == "stratified" else time_split(df)
        F, c = tools(mark)
        zero = F.lit(0.0)
        values = [F.coalesce(finite(c(f"`{n}`")), zero).alias(f"f{i}") for i, n in enumerate(used)]
        return mark.select(c("target").cast("double").alias("y"), c("is_valid"), *values)

    table = narrowed(features, ["symbol", "date", "target", *used])
    return (over_symbols(table, rows, []) if fits_stacks(table) else rows(table)), used


def run_ablation(
    features: DataFrame, groups: dict[str, list[str]], combinations: dict[str, list[str]], path: str, split: str = "stratified"
) -> DataFrame:
    """M-7: one pooled logistic model per combination of feature groups, best first, with the sizes of the split.

    All models are fitted in the same passes over one table, which is written to ``path``. Combinations without any
    present column are skipped.
    """
    rows, used = ablation_rows(features, groups, split)
    # A column for each feature: many of them have few different values, which an array of all would hide.
    spark = features.sparkSession
    with freed_shuffles(spark):
        rows.write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path).select("y", "is_valid", F.array(*[f"f{i}" for i in range(len(used))]).cast("array<double>").alias("x"))
    names, sets = [], []
    for name, parts in combinations.items():
        own = [used.index(n) for g in parts for n in groups[g] if n in used]
        if own:
            names.append(name)
            sets.append(np.array(own))
    train = rows.filter(~c("is_valid"))
    center, scale = logistic.scales(train, len(used))
    betas = logistic.fit_sets(train.select("x", "y"), sets, center, scale)
    found = []
    for at in range(0, len(sets), SCORED):
        part = slice(at, at + SCORED)
        scored = logistic.set_scores(rows, ["y", "is_valid"], sets[part], betas[part], center, scale)
        with freed_shuffles(spark):
            areas = roc_auc(scored.withColumn("model", c("model") + at), "y", "score", ["model", "is_valid"], wide=True).collect()
        found += areas
    areas = spark.createDataFrame(found, "model int, is_valid boolean, n_pos bigint, n_neg bigint, auc double")
    areas = areas.withColumn("rows", c("n_pos") + c("n_neg")).groupBy("model").agg(
        *[F.max(F.when(c("is_valid") == flag, c(n))).alias(alias) for flag, n, alias in (
            (False, "auc", "train_auc"), (True, "auc", "val_auc"), (False, "rows", "train_rows"), (True, "rows", "val_rows"))]
    )
    known = spark.createDataFrame([(k, n, len(s)) for k, (n, s) in enumerate(zip(names, sets))], "model int, combination string, n_features int")
    rounded = [F.round(n, 4).alias(n) for n in ("train_auc", "val_auc")]
    return leaderboard(known.join(areas, "model").select("combination", "n_features", *rounded, "train_rows", "val_rows"))
