"""The feature pipeline and the registry of feature groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.numeric import drop_incomplete
from tickerloom.operators.indicators import LAGS, add_all_technical, add_target
from tickerloom.operators.macro import US_SERIES, add_fx_features, beside, fill_beside, fx_columns
from tickerloom.operators.sentiment import add_sentiment_means, with_sentiment
from tickerloom.operators.stacks import over_symbols, tools
from tickerloom.sources.bars import PRICES, with_min_history

MIN_ROWS = 300

# The columns of each group, in model order.
FEATURE_GROUPS = {
    "technical": [
        "open-close", "low-high", "is_quarter_end",
        "SMA_7", "SMA_21", "SMA_50",
        "MACD", "MACD_signal", "MACD_hist",
        "RSI_14", "BB_width", "BB_upper", "BB_lower",
        "ATR_14", "Stoch_K", "Stoch_D",
        "OBV", "Momentum_10", "VWAP",
    ],
    "technical_extra": [
        "EMA_12_26_cross", "SMA_7_21_cross",
        "ADX_14", "Plus_DI", "Minus_DI",
        "close_above_SMA50", "close_above_SMA21",
        "KC_width", "BB_pctB", "HV_10", "HV_30", "ATR_pct",
        "Vol_ratio", "MFI_14", "CMF_20", "Force_13",
        "Williams_R", "CCI_20", "ROC_5", "ROC_10", "ROC_20", "TSI",
        "return_1d", "return_5d", "return_20d",
        "close_position", "gap", "body_ratio",
        "upper_shadow", "lower_shadow",
        "pct_from_52w_high", "pct_from_52w_low", "dist_from_SMA50",
        *[f"return_lag_{k}" for k in LAGS],
        *[f"volume_chg_lag_{k}" for k in LAGS],
    ],
    "sentiment": ["avg_sentiment", "news_count", "sentiment_7d", "sentiment_14d", "sentiment_30d"],
    "macro_fx": [
        "USD_change", "USD_change_5d", "USD_sma_7",
        "close_usd", "close_usd_change",
        "TP_DK_USD_S_YTL", "TP_DK_USD_A_YTL",
        "USD_spread", "USD_volatility", "EUR_USD_ratio",
    ],
    "macro_other": ["TP_FG_J0", "TP_FG_J01", "TP_FG_J02", "TP_AB_B1", "TP_AB_B3"],
    "fred": [n for n in US_SERIES.values() if n != "EUR/USD"],
}
DEFAULT_GROUPS = ["technical", "technical_extra", "sentiment"]

# Combinations of groups compared in the ablation runs.
COMBINATIONS = {
    "only_technical": ["technical"],
    "technical+sentiment": ["technical", "sentiment"],
    "technical+macro_fx": ["technical", "macro_fx"],
    "technical+fred": ["technical", "fred"],
    "technical+sentiment+macro": ["technical", "sentiment", "macro_fx", "macro_other"],
    "all": ["technical", "sentiment", "macro_fx", "macro_other", "fred"],
}
COMBINATIONS_EXTENDED = {
    "only_technical": ["technical"],
    "tech+tech_extra": ["technical", "technical_extra"],
    "technical+sentiment": ["technical", "sentiment"],
    "technical+macro_fx": ["technical", "macro_fx"],
    "technical+fred": ["technical", "fred"],
    "tech+extra+sentiment": ["technical", "technical_extra", "sentiment"],
    "tech+macro+fred": ["technical", "macro_fx", "fred"],
    "technical+sentiment+macro": ["technical", "sentiment", "macro_fx"],
    "all": ["technical", "sentiment", "macro_fx", "fred"],
    "all_extended": ["technical", "technical_extra", "sentiment", "macro_fx", "fred"],
}


def feature_columns(groups: list[str] | None = None) -> list[str]:
    """P-1: columns of the groups in order; unknown groups are empty."""
    return [n for g in (DEFAULT_GROUPS if groups is None else groups) for n in FEATURE_GROUPS.get(g, [])]


def select_features(df: DataFrame, groups: list[str] | None = None, keys=("symbol", "date", "target")) -> DataFrame:
    """P-1: keys and the present columns of the groups."""
    names = [n for n in (*keys, *feature_columns(groups)) if n in df.columns]
    return df.select(*[F.col(f"`{n}`") for n in names])


def with_missing_features(df: DataFrame, names: list[str]) -> DataFrame:
    """P-2: absent feature columns are 0."""
    return df.withColumns({n: F.lit(0.0) for n in names if n not in df.columns})


# What is joined to the bars, until it is filled over the symbol's rows.
_FX, _US, _NEWS = "_fx_", "_us_", "_news_"
NEWS = ["avg_sentiment", "news_count"]


def _all_beside(bars: DataFrame, fx: DataFrame | None, us: DataFrame | None, daily: DataFrame | None) -> tuple[DataFrame, list[str], list[str]]:
    """Bars with the day's sentiment and macro values, and the names of the FX and of the US columns.

    The rows are narrow here, and one exchange by symbol then serves all windows. ``daily`` has a row per symbol and day,
    a macro table one per date.
    """
    df = with_sentiment(bars, daily)
    df = df.withColumnsRenamed({n: f"{_NEWS}{n}" for n in NEWS})
    names = []
    for wide, prefix in ((fx_columns(fx), _FX), (us, _US)):
        names.append([n for n in wide.columns if n != "date"] if wide is not None else [])
        df = beside(df, wide, prefix) if names[-1] else df
    return df, *names


def _sentiment(df: DataFrame) -> DataFrame:
    _, c = tools(df)
    found = {f"{_NEWS}{n}" for n in NEWS}
    df = df.select(*[c(f"`{n}`") for n in df.columns if n not in found], *[c(f"{_NEWS}{n}").alias(n) for n in NEWS])
    return add_sentiment_means(df)


def _macro(df: DataFrame, names: list[str]) -> DataFrame:
    return add_fx_features(fill_beside(df, names, _FX)) if names else df


def _complete(df: DataFrame) -> DataFrame:
    """Rows with a value in all columns but those that are still to be filled."""
    return drop_incomplete(df, [n for n in df.columns if not n.startswith((_FX, _US, _NEWS))])


def build_features(
    bars: DataFrame,
    fx: DataFrame | None = None,
    us: DataFrame | None = None,
    daily: DataFrame | None = None,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """D-46: all features of all symbols, complete rows only.

    Symbols with too short a history before or after are left out (P-5). Write
    the result once and read it for both training and scoring.
    """
    df, fx_names, us_names = _all_beside(add_target(with_min_history(bars, min_rows)), fx, us, daily)

    def features(df: DataFrame) -> DataFrame:
        df = fill_beside(_macro(_sentiment(df), fx_names), us_names, _US)
        return with_min_history(_complete(add_all_technical(df)), min_rows)

    return over_symbols(df, features, _numbers(df))


def build_features_macro_first(
    bars: DataFrame, fx: DataFrame, us: DataFrame, daily: DataFrame | None = None
) -> DataFrame:
    """D-46b: the exploratory order, with incomplete rows dropped after each block."""
    df, fx_names, us_names = _all_beside(bars, fx, us, daily)

    def features(df: DataFrame) -> DataFrame:
        df = _sentiment(_complete(_macro(df, fx_names)))
        df = _complete(add_all_technical(df))
        return add_target(fill_beside(df, us_names, _US, backfill=True))

    return over_symbols(df, features, _numbers(df))


def _numbers(df: DataFrame) -> list[str]:
    """The columns that the windows compute with."""
    return [n for n in df.columns if n in {*PRICES, "volume", f"{_NEWS}avg_sentiment"} or n.startswith((_FX, _US))]
