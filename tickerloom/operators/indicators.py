"""Technical indicators: bars in, bars plus columns out.

Both blocks are written as layers, each one ``withColumns`` over the layer
before it, so Spark evaluates them after a single shuffle on the symbol. To get
one indicator only, select it from the result: the optimizer drops the windows
that nothing reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.numeric import EPS, div
from tickerloom.operators import timeseries as ts
from tickerloom.operators.stacks import tools
from tickerloom.operators.timeseries import Ewm

# Trading days of a year, used by the volatility and 52-week features.
YEAR = 252
LAGS = (1, 2, 3, 5)


def add_target(df: DataFrame, drop_last: bool = False) -> DataFrame:
    """D-1: 1 if the next close is higher, else 0 (also 0 on a symbol's last row)."""
    F, c = tools(df)
    nxt = ts.lead(c("close"))
    up = F.when(nxt > c("close"), 1).otherwise(0)
    if drop_last:
        up = F.when(nxt.isNotNull(), up)
    df = df.withColumn("target", up)
    return df.filter(c("target").isNotNull()) if drop_last else df


def quarter_end(date, by_month: bool = False, F=F):
    """D-4: exact last day of a quarter, or any day of its last month."""
    last_month = F.month(date) % 3 == 0
    flag = last_month if by_month else (last_month & (date == F.last_day(date)))
    return flag.cast("int")


def add_smoothed(df: DataFrame, extra: bool = True) -> DataFrame:
    """Every exponentially smoothed column (D-6, D-7, and with ``extra`` D-18, D-25, D-29).

    Runs first, while the rows are narrow: smoothing needs its own sort order.
    """
    F, c = tools(df)
    keep = df.columns
    first = {"EMA_12": Ewm("close", 12), "EMA_26": Ewm("close", 26)}
    second = {"MACD_signal": Ewm("MACD", 9)}
    df = ts.with_blocks(df, [9, 12, 13, 20, 25, 26])
    if extra:
        df = df.withColumn("_step", ts.diff(c("close")))
        df = df.withColumns({"_force": c("_step") * c("volume"), "_abs_step": F.abs(c("_step"))})
        first |= {
            "KC_mid": Ewm("close", 20),
            "Force_13": Ewm("_force", 13),
            "_pc1": Ewm("_step", 25, adjust=True),
            "_ab1": Ewm("_abs_step", 25, adjust=True),
        }
        second |= {"_pc2": Ewm("_pc1", 13, adjust=True), "_ab2": Ewm("_ab1", 13, adjust=True)}
    df = ts.add_ewm(df, first)
    df = df.withColumn("MACD", c("EMA_12") - c("EMA_26"))
    df = ts.add_ewm(df, second)
    df = df.withColumn("MACD_hist", c("MACD") - c("MACD_signal"))
    if extra:
        df = df.withColumn("TSI", 100 * c("_pc2") / (c("_ab2") + F.lit(EPS)))
    return df.select(*[c(f"`{n}`") for n in keep + SMOOTHED + (SMOOTHED_EXTRA if extra else [])])


SMOOTHED = ["EMA_12", "EMA_26", "MACD", "MACD_signal", "MACD_hist"]
SMOOTHED_EXTRA = ["KC_mid", "Force_13", "TSI"]


def _smoothed_first(df: DataFrame, extra: bool) -> DataFrame:
    wanted = SMOOTHED_EXTRA if extra else SMOOTHED
    if set(wanted) <= set(df.columns):
        return df
    return add_smoothed(df.drop(*SMOOTHED, *SMOOTHED_EXTRA), extra)


def add_technical(df: DataFrame, quarter_by_month: bool = False) -> DataFrame:
    """D-2 to D-14."""
    df = _smoothed_first(df, extra=False)
    F, c = tools(df)
    keep = [n for n in df.columns if n not in TECHNICAL]
    close, high, low, vol = c("close"), c("high"), c("low"), c("volume")
    typical = (high + low + close) / 3

    df = df.withColumns(
        {
            "open-close": c("open") - close,
            "low-high": low - high,
            "is_quarter_end": quarter_end(c("date"), quarter_by_month, F),
            "SMA_7": ts.roll_mean(close, 7),
            "SMA_21": ts.roll_mean(close, 21),
            "SMA_50": ts.roll_mean(close, 50),
            "BB_mid": ts.roll_mean(close, 20),
            "BB_std": ts.roll_std(close, 20),
            "Momentum_10": ts.diff(close, 10),
            "VWAP": div(ts.cum_sum(vol * (high + low + close) / 3), ts.cum_sum(vol)),
            "_step": ts.diff(close),
            "_prev": ts.lag(close),
            "_low14": ts.roll_min(low, 14),
            "_high14": ts.roll_max(high, 14),
        }
    )
    step = c("_step")
    df = df.withColumns(
        {
            "_gain": F.when(step > 0, step).otherwise(0.0),
            "_loss": F.when(step < 0, -step).otherwise(0.0),
            "_range": F.greatest(high - low, F.abs(high - c("_prev")), F.abs(low - c("_prev"))),
            "BB_upper": c("BB_mid") + 2 * c("BB_std"),
            "BB_lower": c("BB_mid") - 2 * c("BB_std"),
            "BB_width": (c("BB_mid") + 2 * c("BB_std")) - (c("BB_mid") - 2 * c("BB_std")),
            "Stoch_K": div(100 * (close - c("_low14")), c("_high14") - c("_low14")),
        }
    )
    df = df.withColumns(
        {
            "_avg_gain": ts.roll_mean(c("_gain"), 14),
            "_avg_loss": ts.roll_mean(c("_loss"), 14),
            "ATR_14": ts.roll_mean(c("_range"), 14),
            "Stoch_D": ts.roll_mean(c("Stoch_K"), 3),
            "OBV": ts.cum_sum(F.coalesce(F.signum(step) * vol, F.lit(0.0))),
        }
    )
    df = df.withColumn("RSI_14", _rsi(c("_avg_gain"), c("_avg_loss"), F))
    return df.select(*[c(f"`{n}`") for n in keep + TECHNICAL])


def _rsi(gain, loss, F):
    """100 without losses, null without any move."""
    return F.when((loss == 0) & (gain > 0), 100.0).otherwise(100 - div(F.lit(100.0), 1 + div(gain, loss)))


TECHNICAL = [
    "open-close", "low-high", "is_quarter_end",
    "SMA_7", "SMA_21", "SMA_50",
    "EMA_12", "EMA_26", "MACD", "MACD_signal", "MACD_hist",
    "RSI_14",
    "BB_mid", "BB_std", "BB_upper", "BB_lower", "BB_width",
    "ATR_14", "Stoch_K", "Stoch_D",
    "OBV", "Momentum_10", "VWAP",
]


def add_technical_extra(df: DataFrame) -> DataFrame:
    """D-15 to D-37; needs the columns of ``add_technical``."""
    df = _smoothed_first(df, extra=True)
    F, c = tools(df)
    keep = [n for n in df.columns if n not in TECHNICAL_EXTRA]
    open_, close, high, low, vol = c("open"), c("close"), c("high"), c("low"), c("volume")
    spread = high - low
    eps = F.lit(EPS)

    df = df.withColumns({"_c": ts.ffill(close), "_v": ts.ffill(vol), "_tp": (high + low + close) / 3})
    df = df.withColumns(
        {
            "EMA_12_26_cross": c("EMA_12") - c("EMA_26"),
            "SMA_7_21_cross": c("SMA_7") - c("SMA_21"),
            "close_above_SMA50": F.coalesce(close > c("SMA_50"), F.lit(False)).cast("int"),
            "close_above_SMA21": F.coalesce(close > c("SMA_21"), F.lit(False)).cast("int"),
            "BB_pctB": (close - c("BB_lower")) / (c("BB_upper") - c("BB_lower") + eps),
            "ATR_pct": div(c("ATR_14"), close) * 100,
            "Vol_SMA_20": ts.roll_mean(vol, 20),
            "_prev": ts.lag(close),
            "_up": ts.diff(high),
            "_down": -ts.diff(low),
            "_tp_step": ts.diff(c("_tp")),
            "_tp_mean": ts.roll_mean(c("_tp"), 20),
            "_tp_std": ts.roll_std(c("_tp"), 20),
            "_low14": ts.roll_min(low, 14),
            "_high14": ts.roll_max(high, 14),
            "_vol20": ts.roll_sum(vol, 20),
            "_clv": ((close - low) - (high - close)) / (spread + eps),
            "return_1d": ts.pct_change(c("_c"), 1),
            "return_5d": ts.pct_change(c("_c"), 5),
            "return_20d": ts.pct_change(c("_c"), 20),
            "ROC_5": ts.pct_change(c("_c"), 5) * 100,
            "ROC_10": ts.pct_change(c("_c"), 10) * 100,
            "ROC_20": ts.pct_change(c("_c"), 20) * 100,
            "_vol_chg": ts.pct_change(c("_v"), 1),
            "close_position": (close - low) / (spread + eps),
            "body_ratio": F.abs(close - open_) / (spread + eps),
            "upper_shadow": (high - F.greatest(open_, close)) / (spread + eps),
            "lower_shadow": (F.least(open_, close) - low) / (spread + eps),
            "dist_from_SMA50": (close - c("SMA_50")) / (c("SMA_50") + eps) * 100,
        }
    )
    df = ts.add_long_extremes(df, {"_low252": (F.least, "_low14"), "_high252": (F.greatest, "_high14")}, YEAR, 14)
    df = df.withColumns(
        {
            "_plus": F.when((c("_up") > c("_down")) & (c("_up") > 0), c("_up")).otherwise(0.0),
            "_flow": c("_tp") * vol,
            "gap": (open_ - c("_prev")) / (c("_prev") + eps),
            "Vol_ratio": vol / (c("Vol_SMA_20") + eps),
            "Williams_R": -100 * (c("_high14") - close) / (c("_high14") - c("_low14") + eps),
            "CCI_20": (c("_tp") - c("_tp_mean")) / (0.015 * c("_tp_std") + eps),
            "pct_from_52w_high": div(close, c("_high252")) - 1,
            "pct_from_52w_low": div(close, c("_low252")) - 1,
        }
    )
    df = df.withColumns(
        {
            # The downward move is compared with the upward move after its own masking.
            "_minus": F.when((c("_down") > c("_plus")) & (c("_down") > 0), c("_down")).otherwise(0.0),
            "_pos_flow": F.when(c("_tp_step") > 0, c("_flow")).otherwise(0.0),
            "_neg_flow": F.when(c("_tp_step") < 0, F.abs(c("_flow"))).otherwise(0.0),
        }
    )
    lags = {}
    for k in LAGS:
        lags[f"return_lag_{k}"] = ts.lag(c("return_1d"), k)
        lags[f"volume_chg_lag_{k}"] = ts.lag(c("_vol_chg"), k)
    df = df.withColumns(
        {
            "_plus14": ts.roll_mean(c("_plus"), 14),
            "_minus14": ts.roll_mean(c("_minus"), 14),
            "_pos14": ts.roll_sum(c("_pos_flow"), 14),
            "_neg14": ts.roll_sum(c("_neg_flow"), 14),
            "_clv20": ts.roll_sum(c("_clv") * vol, 20),
            "HV_10": ts.roll_std(c("return_1d"), 10) * F.sqrt(F.lit(float(YEAR))) * 100,
            "HV_30": ts.roll_std(c("return_1d"), 30) * F.sqrt(F.lit(float(YEAR))) * 100,
            **lags,
        }
    )
    df = df.withColumns(
        {
            "Plus_DI": 100 * (c("_plus14") / (c("ATR_14") + eps)),
            "Minus_DI": 100 * (c("_minus14") / (c("ATR_14") + eps)),
            "MFI_14": 100 - (100 / (1 + c("_pos14") / (c("_neg14") + eps))),
            "CMF_20": c("_clv20") / (c("_vol20") + eps),
        }
    )
    df = df.withColumn(
        "_dx", 100 * F.abs(c("Plus_DI") - c("Minus_DI")) / (c("Plus_DI") + c("Minus_DI") + eps)
    )
    df = df.withColumn("ADX_14", ts.roll_mean(c("_dx"), 14))
    df = df.withColumns(
        {
            "KC_upper": c("KC_mid") + 1.5 * c("ATR_14"),
            "KC_lower": c("KC_mid") - 1.5 * c("ATR_14"),
            "KC_width": (c("KC_mid") + 1.5 * c("ATR_14")) - (c("KC_mid") - 1.5 * c("ATR_14")),
        }
    )
    return df.select(*[c(f"`{n}`") for n in keep + TECHNICAL_EXTRA])


TECHNICAL_EXTRA = [
    "EMA_12_26_cross", "SMA_7_21_cross",
    "ADX_14", "Plus_DI", "Minus_DI",
    "close_above_SMA50", "close_above_SMA21",
    "KC_mid", "KC_upper", "KC_lower", "KC_width",
    "BB_pctB", "HV_10", "HV_30", "ATR_pct",
    "Vol_SMA_20", "Vol_ratio", "MFI_14", "CMF_20", "Force_13",
    "Williams_R", "CCI_20", "ROC_5", "ROC_10", "ROC_20", "TSI",
    "return_1d", "return_5d", "return_20d",
    "close_position", "gap", "body_ratio", "upper_shadow", "lower_shadow",
    "pct_from_52w_high", "pct_from_52w_low", "dist_from_SMA50",
    *[f"return_lag_{k}" for k in LAGS],
    *[f"volume_chg_lag_{k}" for k in LAGS],
]


def add_all_technical(df: DataFrame, quarter_by_month: bool = False) -> DataFrame:
    """Both blocks; smooths first, so that the wide rows are sorted once."""
    return add_technical_extra(add_technical(add_smoothed(df), quarter_by_month))
