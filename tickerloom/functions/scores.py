"""Maps from labels, scores and probabilities to the classes used downstream."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model labels and their weights, strong to weak thresholds.
LABEL_WEIGHTS = {"LABEL_2": 1, "LABEL_1": 0, "LABEL_0": -1}
LABEL_NAMES = {"LABEL_0": "🔴 Negatif", "LABEL_1": "🟡 Nötr", "LABEL_2": "🟢 Pozitif"}
SENTIMENT_IDS = {"negative": 0, "neutral": 1, "positive": 2}
CLASS_NAMES = {
    2: "🟢 GÜÇLÜ POZİTİF",
    1: "🌿 HAFİF POZİTİF",
    -2: "🔴 GÜÇLÜ NEGATİF",
    -1: "🍂 HAFİF NEGATİF",
    0: "⚪ NÖTR / BELİRSİZ",
}
STRONG_SCORE, WEAK_SCORE = 0.15, 0.05
STRONG_BUY, BUY, SELL, STRONG_SELL = 0.65, 0.55, 0.45, 0.35


def _lookup(values: dict, key: Column) -> Column:
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(values.items())])
    return F.try_element_at(pairs, key)


def label_weight(label: Column) -> Column:
    """F-3: unknown labels weigh 0."""
    return F.coalesce(_lookup(LABEL_WEIGHTS, label), F.lit(0))


def label_name(label: Column) -> Column:
    return F.coalesce(_lookup(LABEL_NAMES, label), label)


def sentiment_id(name: Column) -> Column:
    """F-20."""
    return _lookup(SENTIMENT_IDS, name)


def score_class(score: Column) -> Column:
    """F-4: five classes with strict thresholds."""
    return (
        F.when(score > STRONG_SCORE, 2)
        .when(score > WEAK_SCORE, 1)
        .when(score < -STRONG_SCORE, -2)
        .when(score < -WEAK_SCORE, -1)
        .otherwise(0)
    )


def class_name(cls: Column) -> Column:
    return _lookup(CLASS_NAMES, cls)


def signal(probability: Column) -> Column:
    """F-5: trading signal of an up-probability."""
    return (
        F.when(probability >= STRONG_BUY, 2)
        .when(probability >= BUY, 1)
        .when(probability <= STRONG_SELL, -2)
        .when(probability <= SELL, -1)
        .otherwise(0)
    )


def action(sig: Column) -> Column:
    """P-11."""
    return F.when(sig > 0, "buy").when(sig < 0, "sell").otherwise("hold")
