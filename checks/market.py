"""Queries over bars: sources, windows, indicators, summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import datasets as d
from checks.sqltools import BARS, W, ewm, ewm_adjusted, ffill, lag, over, pct, roll, rounded, with_
from tickerloom.functions import numeric
from tickerloom.operators import explore, indicators, timeseries as ts
from tickerloom.plans import features
from tickerloom.sources import bars as src
from tickerloom.sources import company as companies
from tickerloom.sources import tables

QUERIES, ORACLES = {}, {}
c = F.col


def rounds(df, digits):
    return df.select(
        *[c(f"`{n}`") if k is None else (F.round(c(f"`{n}`"), k) + F.lit(0.0)).alias(n) for n, k in digits.items()]
    )


def keyed(*names, k=4, **digits):
    out = {"symbol": None, "date": None}
    out.update({n: digits.get(n, k) for n in names})
    return out


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# -- bars --------------------------------------------------------------------------

OHLCV = ["open", "high", "low", "close", "volume"]
# Prices are the same arithmetic on both sides: they are compared exactly.
BAR = keyed(*OHLCV, k=None)
add("bars_daily", lambda s, p: rounds(d.bars(s, p), BAR), with_(BARS, select=f"SELECT {rounded(BAR)} FROM bars"))

AS_OF = dt.date(2000, 6, 30)
add(
    "bars_recent_history",
    lambda s, p: rounds(src.recent_history(d.bars(s, p), AS_OF, 2000), BAR),
    with_(BARS, select=f"SELECT {rounded(BAR)} FROM bars WHERE date > DATE '2000-06-30' - 2000 AND date <= DATE '2000-06-30'"),
)
add(
    "bars_in_order_range",
    lambda s, p: rounds(
        src.bars_in_range_of(
            d.bars(s, p), d.table(s, p, "orders").select(c("o_orderdate").cast("date").alias("date"))
        ),
        BAR,
    ),
    with_(
        BARS,
        select=f"""SELECT {rounded(BAR)} FROM bars WHERE date BETWEEN
        (SELECT CAST(min(o_orderdate) AS DATE) FROM orders) AND (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)""",
    ),
)
add(
    "min_history",
    lambda s, p: rounds(src.with_min_history(d.bars(s, p), 520), BAR),
    with_(
        BARS,
        select=f"SELECT {rounded(BAR)} FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars) WHERE n >= 520",
    ),
)
RES = {"symbol": None, "period": None, "close": None, "volume": None}
for _f, _end in [
    ("W", "CAST(date_trunc('week', date) AS DATE) + 6"),
    ("M", "last_day(date)"),
    ("Q", "last_day(CAST(date_trunc('quarter', date) AS DATE) + INTERVAL 2 MONTH)"),
]:
    add(
        f"resample_last_{_f.lower()}",
        lambda s, p, f=_f: rounds(src.resample_last(d.bars(s, p), f, columns=["close", "volume"]), RES),
        with_(
            BARS,
            select=f"""SELECT {rounded(RES)} FROM (SELECT symbol, CAST({_end} AS DATE) AS period,
            arg_max(close, date) AS close, arg_max(volume, date) AS volume FROM bars GROUP BY 1, 2)""",
        ),
    )
add(
    "local_trading_date",
    lambda s, p: d.table(s, p, "events").select(
        "event_id", src.local_date(c("ts").cast("timestamp_ntz").cast("timestamp")).alias("day")
    ),
    "SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Istanbul' AS DATE) AS day FROM events",
)

# -- window primitives ---------------------------------------------------------------

PRIMITIVES = {
    "lag": (lambda: ts.lag(c("close"), 3), lag("close", 3), None),
    "lead": (lambda: ts.lead(c("close"), 1), f"lead(close, 1) OVER ({W})", None),
    "diff": (lambda: ts.diff(c("close")), f"close - {lag('close')}", None),
    "pct_change": (lambda: ts.pct_change(c("close"), 5), pct("close", 5), 6),
    "rolling_mean": (lambda: ts.roll_mean(c("close"), 7), roll("avg", "close", 7), 4),
    "rolling_sum": (lambda: ts.roll_sum(c("close"), 14), roll("sum", "close", 14), 4),
    "rolling_std": (lambda: ts.roll_std(c("close"), 20), roll("stddev_samp", "close", 20), 4),
    "rolling_min": (lambda: ts.roll_min(c("low"), 14), roll("min", "low", 14), None),
    "rolling_max": (lambda: ts.roll_max(c("high"), 252), roll("max", "high", 252), None),
    "cumulative_sum": (lambda: ts.cum_sum(c("volume")), f"sum(volume) {over()}", None),
}
for _n, (_col, _sql, _k) in PRIMITIVES.items():
    add(
        f"window_{_n}",
        lambda s, p, col=_col, k=_k: rounds(d.bars(s, p).withColumn("value", col()), keyed("value", k=k)),
        with_(
            BARS, f"x AS (SELECT symbol, date, {_sql} AS value FROM bars)",
              select=f"SELECT {rounded(keyed('value', k=_k))} FROM x"),
    )
RN = f"b AS (SELECT *, row_number() OVER ({W}) AS rn FROM bars)"
add(
    "ewm_recursive",
    lambda s, p: rounds(ts.add_ewm(d.bars(s, p), {"value": ts.Ewm("close", 12)}), keyed("value")),
    with_(BARS, RN, select=f"SELECT symbol, date, round({ewm('close', 12)}, 4) + 0.0 AS value FROM b"),
)
add(
    "ewm_normalised",
    lambda s, p: rounds(ts.add_ewm(d.bars(s, p), {"value": ts.Ewm("close", 25, True)}), keyed("value")),
    with_(BARS, RN, select=f"SELECT symbol, date, round({ewm_adjusted('close', 25)}, 4) + 0.0 AS value FROM b"),
)
# Gaps: closes of days with a volume under 10 count as missing.
GAP = "CASE WHEN volume >= 10 THEN close END"


def _gap():
    return F.when(c("volume") >= 10, c("close"))


add(
    "forward_fill",
    lambda s, p: rounds(d.bars(s, p).withColumn("g", _gap()).withColumn("value", ts.ffill(c("g"))), keyed("value", k=None)),
    with_(BARS, f"g AS (SELECT *, {GAP} AS g FROM bars)",
          select=f"SELECT symbol, date, {ffill('g')} AS value FROM g"),
)
add(
    "backward_fill",
    lambda s, p: rounds(d.bars(s, p).withColumn("g", _gap()).withColumn("value", ts.bfill(c("g"))), keyed("value", k=None)),
    with_(BARS, f"g AS (SELECT *, {GAP} AS g FROM bars)",
          select=f"""SELECT symbol, date, first_value(g IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW
          AND UNBOUNDED FOLLOWING) AS value FROM g"""),
)
add(
    "ewm_with_gaps",
    lambda s, p: rounds(
        ts.add_ewm(d.bars(s, p).withColumn("g", _gap()), {"value": ts.Ewm("g", 25, True)}), keyed("value")
    ),
    with_(BARS, f"b AS (SELECT *, {GAP} AS g, row_number() OVER ({W}) AS rn FROM bars)",
          select=f"SELECT symbol, date, round({ewm_adjusted('g', 25)}, 4) + 0.0 AS value FROM b"),
)
add(
    "last_row_per_symbol",
    lambda s, p: rounds(ts.last_per_symbol(d.bars(s, p)), BAR),
    with_(BARS, select=f"""SELECT {rounded(BAR)} FROM (SELECT *, row_number() OVER (PARTITION BY symbol
    ORDER BY date DESC) AS rn FROM bars) WHERE rn = 1"""),
)
add(
    "head_per_symbol",
    lambda s, p: rounds(ts.head(d.bars(s, p), 5), BAR),
    with_(BARS, RN, select=f"SELECT {rounded(BAR)} FROM b WHERE rn <= 5"),
)
add(
    "tail_per_symbol",
    lambda s, p: rounds(ts.tail(d.bars(s, p), 5), BAR),
    with_(BARS, select=f"""SELECT {rounded(BAR)} FROM (SELECT *, row_number() OVER (PARTITION BY symbol
    ORDER BY date DESC) AS rn FROM bars) WHERE rn <= 5"""),
)

# -- indicators -------------------------------------------------------------------------

TARGET = f"CASE WHEN lead(close) OVER ({W}) > close THEN 1 ELSE 0 END"
add(
    "target_next_day",
    lambda s, p: indicators.add_target(d.bars(s, p)).select("symbol", "date", "target"),
    with_(BARS, select=f"SELECT symbol, date, {TARGET} AS target FROM bars"),
)

# Layers of the technical blocks in SQL: each reads the one before.
T1 = f"""t1 AS (SELECT *, row_number() OVER ({W}) AS rn, close - {lag('close')} AS step, {lag('close')} AS prev,
  {roll('min', 'low', 14)} AS low14, {roll('max', 'high', 14)} AS high14,
  {roll('min', 'low', 252)} AS low252, {roll('max', 'high', 252)} AS high252,
  {roll('avg', 'close', 7)} AS "SMA_7", {roll('avg', 'close', 21)} AS "SMA_21", {roll('avg', 'close', 50)} AS "SMA_50",
  {roll('avg', 'close', 20)} AS "BB_mid", {roll('stddev_samp', 'close', 20)} AS "BB_std",
  close - {lag('close', 10)} AS "Momentum_10", (high + low + close) / 3 AS tp,
  high - {lag('high')} AS up, -(low - {lag('low')}) AS down,
  {pct('close')} AS return_1d, {pct('volume')} AS vol_chg
  FROM bars)"""
T2 = f"""t2 AS (SELECT *, CASE WHEN step > 0 THEN step ELSE 0 END AS gain, CASE WHEN step < 0 THEN -step ELSE 0 END AS loss,
  greatest(high - low, abs(high - prev), abs(low - prev)) AS tr,
  100 * (close - low14) / nullif(high14 - low14, 0) AS "Stoch_K",
  coalesce(sign(step) * volume, 0) AS signed_vol,
  "BB_mid" + 2 * "BB_std" AS "BB_upper", "BB_mid" - 2 * "BB_std" AS "BB_lower",
  {ewm('close', 12)} AS "EMA_12", {ewm('close', 26)} AS "EMA_26", {ewm('close', 20)} AS "KC_mid",
  step * volume AS force, abs(step) AS abs_step, tp - {lag('tp')} AS tp_step,
  {roll('avg', 'tp', 20)} AS tp_mean, {roll('stddev_samp', 'tp', 20)} AS tp_std,
  CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS plus
  FROM t1)"""
T3 = f"""t3 AS (SELECT *, {roll('avg', 'gain', 14)} AS ag, {roll('avg', 'loss', 14)} AS al, {roll('avg', 'tr', 14)} AS "ATR_14",
  {roll('avg', '"Stoch_K"', 3)} AS "Stoch_D", sum(signed_vol) {over()} AS "OBV",
  sum(volume * (high + low + close) / 3) {over()} / sum(volume) {over()} AS "VWAP",
  "EMA_12" - "EMA_26" AS "MACD", {ewm('force', 13, 2)} AS "Force_13",
  {ewm_adjusted('step', 25)} AS pc1, {ewm_adjusted('abs_step', 25)} AS ab1,
  CASE WHEN down > plus AND down > 0 THEN down ELSE 0 END AS minus,
  CASE WHEN tp_step > 0 THEN tp * volume ELSE 0 END AS pos_flow,
  CASE WHEN tp_step < 0 THEN abs(tp * volume) ELSE 0 END AS neg_flow,
  ((close - low) - (high - close)) / (high - low + 1e-10) * volume AS clv
  FROM t2)"""
T4 = f"""t4 AS (SELECT *, CASE WHEN al = 0 AND ag > 0 THEN 100.0 ELSE 100 - 100 / nullif(1 + ag / nullif(al, 0), 0) END AS "RSI_14",
  {ewm('"MACD"', 9)} AS "MACD_signal", "BB_upper" - "BB_lower" AS "BB_width",
  {ewm_adjusted('pc1', 13)} AS pc2, {ewm_adjusted('ab1', 13)} AS ab2,
  100 * ({roll('avg', 'plus', 14)} / ("ATR_14" + 1e-10)) AS "Plus_DI",
  100 * ({roll('avg', 'minus', 14)} / ("ATR_14" + 1e-10)) AS "Minus_DI",
  {roll('sum', 'pos_flow', 14)} AS pos14, {roll('sum', 'neg_flow', 14)} AS neg14, {roll('sum', 'clv', 20)} AS clv20,
  {roll('sum', 'volume', 20)} AS vol20, {roll('avg', 'volume', 20)} AS "Vol_SMA_20"
  FROM t3)"""
T5 = """t5 AS (SELECT *, 100 * abs("Plus_DI" - "Minus_DI") / ("Plus_DI" + "Minus_DI" + 1e-10) AS dx FROM t4)"""
TECH = (BARS, T1, T2, T3, T4, T5)

SINGLE = {
    # name: (columns with digits, SQL of the columns)
    "price_spreads": ({"open-close": None, "low-high": None}, 'open - close AS "open-close", low - high AS "low-high"'),
    "quarter_end": (
        {"is_quarter_end": None},
        "CAST(date = last_day(date) AND month(date) % 3 = 0 AS INTEGER) AS is_quarter_end",
    ),
    "sma": ({"SMA_7": 4, "SMA_21": 4, "SMA_50": 4}, '"SMA_7", "SMA_21", "SMA_50"'),
    "ema": ({"EMA_12": 4, "EMA_26": 4}, '"EMA_12", "EMA_26"'),
    "macd": (
        {"MACD": 4, "MACD_signal": 4, "MACD_hist": 4},
        '"MACD", "MACD_signal", "MACD" - "MACD_signal" AS "MACD_hist"',
    ),
    "rsi": ({"RSI_14": 4}, '"RSI_14"'),
    "bollinger": (
        {"BB_mid": 4, "BB_std": 4, "BB_upper": 4, "BB_lower": 4, "BB_width": 4},
        '"BB_mid", "BB_std", "BB_upper", "BB_lower", "BB_width"',
    ),
    "atr": ({"ATR_14": 4}, '"ATR_14"'),
    "stochastic": ({"Stoch_K": 4, "Stoch_D": 4}, '"Stoch_K", "Stoch_D"'),
    "obv": ({"OBV": 4}, '"OBV"'),
    "momentum": ({"Momentum_10": None}, '"Momentum_10"'),
    "vwap": ({"VWAP": 4}, '"VWAP"'),
    "crosses": (
        {"EMA_12_26_cross": 4, "SMA_7_21_cross": 4},
        '"EMA_12" - "EMA_26" AS "EMA_12_26_cross", "SMA_7" - "SMA_21" AS "SMA_7_21_cross"',
    ),
    "adx": (
        {"Plus_DI": 4, "Minus_DI": 4, "ADX_14": 4},
        f'"Plus_DI", "Minus_DI", {roll("avg", "dx", 14)} AS "ADX_14"',
    ),
    "above_sma": (
        {"close_above_SMA50": None, "close_above_SMA21": None},
        'CAST(coalesce(close > "SMA_50", false) AS INTEGER) AS "close_above_SMA50", '
        'CAST(coalesce(close > "SMA_21", false) AS INTEGER) AS "close_above_SMA21"',
    ),
    "keltner": (
        {"KC_mid": 4, "KC_upper": 4, "KC_lower": 4, "KC_width": 4},
        '"KC_mid", "KC_mid" + 1.5 * "ATR_14" AS "KC_upper", "KC_mid" - 1.5 * "ATR_14" AS "KC_lower", '
        '3 * "ATR_14" AS "KC_width"',
    ),
    "bollinger_pct": ({"BB_pctB": 6}, '(close - "BB_lower") / ("BB_upper" - "BB_lower" + 1e-10) AS "BB_pctB"'),
    "historical_volatility": (
        {"HV_10": 4, "HV_30": 4},
        f'{roll("stddev_samp", "return_1d", 10)} * sqrt(252) * 100 AS "HV_10", '
        f'{roll("stddev_samp", "return_1d", 30)} * sqrt(252) * 100 AS "HV_30"',
    ),
    "atr_pct": ({"ATR_pct": 4}, '"ATR_14" / close * 100 AS "ATR_pct"'),
    "volume_ratio": (
        {"Vol_SMA_20": 4, "Vol_ratio": 6},
        '"Vol_SMA_20", volume / ("Vol_SMA_20" + 1e-10) AS "Vol_ratio"',
    ),
    "money_flow_index": ({"MFI_14": 4}, '100 - (100 / (1 + pos14 / (neg14 + 1e-10))) AS "MFI_14"'),
    "chaikin_money_flow": ({"CMF_20": 6}, 'clv20 / (vol20 + 1e-10) AS "CMF_20"'),
    "force_index": ({"Force_13": 2}, '"Force_13"'),
    "williams_r": ({"Williams_R": 4}, '-100 * (high14 - close) / (high14 - low14 + 1e-10) AS "Williams_R"'),
    "cci": ({"CCI_20": 4}, '(tp - tp_mean) / (0.015 * tp_std + 1e-10) AS "CCI_20"'),
    "rate_of_change": (
        {"ROC_5": 4, "ROC_10": 4, "ROC_20": 4},
        f'{pct("close", 5)} * 100 AS "ROC_5", {pct("close", 10)} * 100 AS "ROC_10", {pct("close", 20)} * 100 AS "ROC_20"',
    ),
    "tsi": ({"TSI": 4}, '100 * pc2 / (ab2 + 1e-10) AS "TSI"'),
    "returns": (
        {"return_1d": 6, "return_5d": 6, "return_20d": 6},
        f'return_1d, {pct("close", 5)} AS return_5d, {pct("close", 20)} AS return_20d',
    ),
    "close_position": ({"close_position": 6}, "(close - low) / (high - low + 1e-10) AS close_position"),
    "gap": ({"gap": 6}, "(open - prev) / (prev + 1e-10) AS gap"),
    "body_ratio": ({"body_ratio": 6}, "abs(close - open) / (high - low + 1e-10) AS body_ratio"),
    "shadows": (
        {"upper_shadow": 6, "lower_shadow": 6},
        "(high - greatest(open, close)) / (high - low + 1e-10) AS upper_shadow, "
        "(least(open, close) - low) / (high - low + 1e-10) AS lower_shadow",
    ),
    "distance_52w": (
        {"pct_from_52w_high": 6, "pct_from_52w_low": 6},
        "close / high252 - 1 AS pct_from_52w_high, close / low252 - 1 AS pct_from_52w_low",
    ),
    "distance_sma": ({"dist_from_SMA50": 4}, '(close - "SMA_50") / ("SMA_50" + 1e-10) * 100 AS "dist_from_SMA50"'),
    "lagged_changes": (
        {f"{a}_lag_{k}": 6 for k in (1, 2, 3, 5) for a in ("return", "volume_chg")},
        ", ".join(
            f'{lag(x, k)} AS "{a}_lag_{k}"' for k in (1, 2, 3, 5) for a, x in (("return", "return_1d"), ("volume_chg", "vol_chg"))
        ),
    ),
}


def indicator_query(columns):
    digits = {"symbol": None, "date": None, **columns}
    return lambda s, p: rounds(indicators.add_all_technical(d.bars(s, p)), digits)


for _n, (_cols, _sql) in SINGLE.items():
    add(
        f"indicator_{_n}",
        indicator_query(_cols),
        with_(
            *TECH,
            f"x AS (SELECT symbol, date, {_sql} FROM t5)",
            select=f"SELECT {rounded({'symbol': None, 'date': None, **_cols})} FROM x",
        ),
    )
add(
    "quarter_end_by_month",
    lambda s, p: d.bars(s, p).select("symbol", "date", indicators.quarter_end(c("date"), True).alias("flag")),
    with_(BARS, select="SELECT symbol, date, CAST(month(date) % 3 = 0 AS INTEGER) AS flag FROM bars"),
)

# -- flagship: the first features and the target of the last days ---------------------------

FLAG = {
    "symbol": None, "date": None, "close": None, "SMA_7": 4, "SMA_21": 4, "RSI_14": 4, "BB_upper": 4, "BB_lower": 4,
    "OBV": 4, "target": None,
}


def latest_signals(s, p):
    df = indicators.add_technical(indicators.add_target(d.bars(s, p)))
    return rounds(ts.last_per_symbol(df.select(*FLAG)), FLAG)


add(
    "latest_indicators",
    latest_signals,
    with_(
        *TECH,
        f"x AS (SELECT *, {TARGET} AS target, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM t5)",
        select=f"SELECT {rounded(FLAG)} FROM x WHERE back = 1",
    ),
)

# -- cleaning and selection --------------------------------------------------------------------

add(
    "drop_incomplete_rows",
    lambda s, p: rounds(
        numeric.drop_incomplete(
            d.bars(s, p).withColumns(
                {"m": ts.roll_mean(c("close"), 50), "x": F.when(c("volume") > 20, F.lit(float("inf"))).otherwise(c("close"))}
            )
        ),
        keyed("m", "x", x=None),
    ),
    with_(
        BARS,
        f"x AS (SELECT symbol, date, {roll('avg', 'close', 50)} AS m, CASE WHEN volume > 20 THEN NULL ELSE close END AS x FROM bars)",
        select=f"SELECT {rounded(keyed('m', 'x', x=None))} FROM x WHERE m IS NOT NULL AND x IS NOT NULL",
    ),
)
add(
    "zero_fill",
    lambda s, p: rounds(
        numeric.zero_fill(
            d.bars(s, p).withColumns({"m": ts.roll_mean(c("close"), 50), "x": F.when(c("volume") > 20, F.lit(float("nan"))).otherwise(c("close"))}),
            ["m", "x"],
        ),
        keyed("m", "x", x=None),
    ),
    with_(
        BARS,
        f"x AS (SELECT symbol, date, coalesce({roll('avg', 'close', 50)}, 0) AS m, CASE WHEN volume > 20 THEN 0 ELSE close END AS x FROM bars)",
        select=f"SELECT {rounded(keyed('m', 'x', x=None))} FROM x",
    ),
)
GROUP = {
    "symbol": None, "date": None, "target": None, "open-close": None, "low-high": None, "is_quarter_end": None, "SMA_7": 4,
}


def group_projection(s, p):
    df = indicators.add_target(d.bars(s, p)).withColumns(
        {
            "open-close": c("open") - c("close"),
            "low-high": c("low") - c("high"),
            "is_quarter_end": indicators.quarter_end(c("date")),
            "SMA_7": ts.roll_mean(c("close"), 7),
        }
    )
    return rounds(features.select_features(df, ["technical", "no_such_group"]), GROUP)


add(
    "feature_group_projection",
    group_projection,
    with_(
        BARS,
        f"""x AS (SELECT symbol, date, {TARGET} AS target, open - close AS "open-close", low - high AS "low-high",
        CAST(date = last_day(date) AND month(date) % 3 = 0 AS INTEGER) AS is_quarter_end,
        {roll('avg', 'close', 7)} AS "SMA_7" FROM bars)""",
        select=f"SELECT {rounded(GROUP)} FROM x",
    ),
)
add(
    "missing_features_zero",
    lambda s, p: rounds(
        features.with_missing_features(d.bars(s, p).drop("volume"), ["close", "RSI_14"]), keyed("close", "RSI_14", k=None)
    ),
    with_(BARS, select='SELECT symbol, date, close, CAST(0 AS DOUBLE) AS "RSI_14" FROM bars'),
)
add(
    "quarter_end_sample",
    lambda s, p: rounds(
        d.bars(s, p).filter(indicators.quarter_end(c("date")) == 1).orderBy("date", "symbol").limit(5), BAR
    ),
    with_(BARS, select=f"""SELECT {rounded(BAR)} FROM bars WHERE date = last_day(date) AND month(date) % 3 = 0
    ORDER BY date, symbol LIMIT 5"""),
)
add(
    "drop_column",
    lambda s, p: rounds(d.bars(s, p).drop("volume"), keyed("open", "high", "low", "close", k=None)),
    with_(BARS, select=f"SELECT {rounded(keyed('open', 'high', 'low', 'close', k=None))} FROM bars"),
)

# -- summaries ------------------------------------------------------------------------------------

YEAR = {"symbol": None, "year": None, "open": 4, "high": 4, "low": 4, "close": 4}
add(
    "yearly_mean_ohlc",
    lambda s, p: rounds(explore.yearly_mean(d.bars(s, p)), YEAR),
    with_(
        BARS,
        select=f"""SELECT {rounded(YEAR)} FROM (SELECT symbol, CAST(year(date) AS INTEGER) AS year, avg(open) AS open,
        avg(high) AS high, avg(low) AS low, avg(close) AS close FROM bars GROUP BY 1, 2)""",
    ),
)
FLAGGED = {"flag": None, **{n: 4 for n in OHLCV}}
add(
    "mean_by_quarter_end",
    lambda s, p: rounds(
        explore.mean_by_flag(
            d.bars(s, p).withColumn("flag", indicators.quarter_end(c("date"), True)), "flag", OHLCV
        ),
        FLAGGED,
    ),
    with_(
        BARS,
        select=f"""SELECT {rounded(FLAGGED)} FROM (SELECT CAST(month(date) % 3 = 0 AS INTEGER) AS flag, avg(open) AS open,
        avg(high) AS high, avg(low) AS low, avg(close) AS close, avg(volume) AS volume FROM bars GROUP BY 1)""",
    ),
)
DESC = {"column": None, "count": None, **{n: 4 for n in ("mean", "std", "min", "p25", "p50", "p75", "max")}}
add(
    "describe_bars",
    lambda s, p: rounds(explore.describe(d.bars(s, p), OHLCV), DESC),
    with_(
        BARS,
        "x AS ("
        + " UNION ALL ".join(
            f"""SELECT '{n}' AS "column", count({n}) AS "count", avg({n}) AS mean, stddev_samp({n}) AS std, min({n}) AS min,
            quantile_cont({n}, 0.25) AS p25, quantile_cont({n}, 0.5) AS p50, quantile_cont({n}, 0.75) AS p75,
            max({n}) AS max FROM bars"""
            for n in OHLCV
        )
        + ")",
        select=f"SELECT {rounded(DESC)} FROM x",
    ),
)
add(
    "null_counts",
    lambda s, p: explore.null_counts(
        d.bars(s, p).withColumns({"SMA_50": ts.roll_mean(c("close"), 50), "prev": ts.lag(c("close"))}), ["close", "SMA_50", "prev"]
    ),
    with_(
        BARS,
        f"x AS (SELECT close, {roll('avg', 'close', 50)} AS sma, {lag('close')} AS prev FROM bars)",
        select="""SELECT 'close' AS "column", count(*) - count(close) AS nulls FROM x
        UNION ALL SELECT 'SMA_50', count(*) - count(sma) FROM x UNION ALL SELECT 'prev', count(*) - count(prev) FROM x""",
    ),
)
add(
    "table_shape",
    lambda s, p: explore.shape(d.bars(s, p)),
    with_(BARS, select='SELECT count(*) AS "rows", CAST(7 AS INTEGER) AS "columns" FROM bars'),
)
FREQ = {"target": None, "count": None, "share": 6}
add(
    "class_balance",
    lambda s, p: rounds(explore.frequencies(indicators.add_target(d.bars(s, p)), "target"), FREQ),
    with_(
        BARS,
        f"x AS (SELECT {TARGET} AS target FROM bars)",
        select=f"""SELECT {rounded(FREQ)} FROM (SELECT target, count(*) AS "count",
        count(*) / sum(count(*)) OVER () AS share FROM x GROUP BY target)""",
    ),
)
CORR = {"a": None, "b": None, "corr": 6}
PAIRS = [(a, b) for i, a in enumerate(OHLCV) for b in OHLCV[i + 1 :]]
_corr = "x AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM bars" for a, b in PAIRS) + ")"
add(
    "correlation_matrix",
    lambda s, p: rounds(explore.correlations(d.bars(s, p), OHLCV), CORR),
    with_(BARS, _corr, select=f"SELECT {rounded(CORR)} FROM x"),
)
add(
    "high_correlations",
    lambda s, p: rounds(explore.correlations(d.bars(s, p), OHLCV, above=0.9), CORR),
    with_(BARS, _corr, select=f"SELECT {rounded(CORR)} FROM x WHERE corr > 0.9"),
)
add(
    "feature_correlations",
    lambda s, p: rounds(
        explore.correlations(
            indicators.add_all_technical(indicators.add_target(d.bars(s, p))),
            features.feature_columns(["technical", "technical_extra"]),
        ),
        CORR,
    ),
)
add(
    "histogram_volume",
    lambda s, p: explore.histogram(d.bars(s, p), "volume", 0, 100, 20),
    with_(BARS, select="""SELECT CAST(CASE WHEN volume < 0 THEN 0 WHEN volume >= 100 THEN 21
    ELSE floor(volume / 5) + 1 END AS BIGINT) AS bin, count(*) AS "count" FROM bars GROUP BY 1"""),
)
BOX = {"symbol": None, "p25": 4, "p50": 4, "p75": 4, "low": None, "high": None, "outliers": None}
add(
    "box_stats_close",
    lambda s, p: rounds(explore.box_stats(d.bars(s, p), "symbol", "close"), BOX),
    with_(
        BARS,
        """q AS (SELECT symbol, quantile_cont(close, 0.25) AS p25, quantile_cont(close, 0.5) AS p50,
        quantile_cont(close, 0.75) AS p75 FROM bars GROUP BY symbol)""",
        """n AS (SELECT q.*, close, close BETWEEN p25 - 1.5 * (p75 - p25) AND p75 + 1.5 * (p75 - p25) AS ok
        FROM bars JOIN q USING (symbol))""",
        select=f"""SELECT {rounded(BOX)} FROM (SELECT symbol, p25, p50, p75, min(close) FILTER (WHERE ok) AS low,
        max(close) FILTER (WHERE ok) AS high, count(*) FILTER (WHERE NOT ok) AS outliers FROM n GROUP BY 1, 2, 3, 4)""",
    ),
)
add(
    "date_range",
    lambda s, p: explore.date_range(d.bars(s, p)),
    with_(BARS, select="SELECT min(date) AS first, max(date) AS last FROM bars"),
)
add(
    "calendar_columns",
    lambda s, p: explore.with_calendar(d.bars(s, p)).select("symbol", "date", "day", "month", "year"),
    with_(BARS, select="""SELECT symbol, date, CAST(day(date) AS INTEGER) AS day, CAST(month(date) AS INTEGER) AS month,
    CAST(year(date) AS INTEGER) AS year FROM bars"""),
)
add(
    "sorted_bars",
    lambda s, p: rounds(d.bars(s, p).orderBy("date", "symbol").limit(20), BAR),
    with_(BARS, select=f"SELECT {rounded(BAR)} FROM bars ORDER BY date, symbol LIMIT 20"),
)
add(
    "sql_with_parameters",
    lambda s, p: tables.query(
        s,
        "SELECT symbol, count(*) AS days FROM bars_view WHERE date >= :start AND volume > :volume GROUP BY symbol",
        {"bars_view": d.bars(s, p)},
        {"start": dt.date(1998, 1, 1), "volume": 25.0},
    ),
    with_(BARS, select="SELECT symbol, count(*) AS days FROM bars WHERE date >= DATE '1998-01-01' AND volume > 25 GROUP BY symbol"),
)
# The suppliers as a company list; region names play the banned codes.
add(
    "company_list",
    lambda s, p: companies.usable_companies(
        d.table(s, p, "supplier").select(
            c("s_suppkey").cast("string").alias("code"), F.when(c("s_acctbal") >= 0, c("s_name")).alias("name")
        ),
        ["3", "7"],
    ),
    """SELECT CAST(s_suppkey AS VARCHAR) AS code, s_name AS name FROM supplier
    WHERE s_acctbal >= 0 AND s_suppkey NOT IN (3, 7)""",
)
