"""Queries over macro series, sentiment joins and the whole feature pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import datasets as d
from checks.market import TARGET, TECH, rounds
from checks.news_sql import SCORED
from checks.sqltools import BARS, W, ffill, lag, pct, roll, rounded, with_
from tickerloom.operators import macro, sentiment
from tickerloom.plans import features
from tickerloom.sources import macro as src

QUERIES, ORACLES = {}, {}
c = F.col


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def long_sql(name, by):
    return f"""{name}_long AS (SELECT {by} AS series, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS value
    FROM orders GROUP BY 1, 2)"""


def wide_sql(name, columns):
    picks = ", ".join(f"max(CASE WHEN series = '{k}' THEN value END) AS \"{v}\"" for k, v in columns.items())
    return f"{name} AS (SELECT date, {picks} FROM {name}_long GROUP BY date)"


FX_LONG, FX = long_sql("fx", "o_orderpriority"), wide_sql("fx", d.FX)
US_LONG, US_RAW = long_sql("us", "o_orderstatus"), wide_sql("us", d.US)
DAY = "ORDER BY date"
US_FILLED = (
    "usf AS (SELECT date, " + ", ".join(f'{ffill(chr(34) + v + chr(34), DAY)} AS "{v}"' for v in d.US.values()) + " FROM us)"
)
FX_K = {"date": None, **{v: 5 for v in d.FX.values()}}
US_K = {"date": None, **{v: 5 for v in d.US.values()}}

add(
    "macro_wide",
    lambda s, p: rounds(d.fx(s, p), FX_K),
    with_(FX_LONG, FX, select=f"SELECT {rounded(FX_K)} FROM fx"),
)
add(
    "macro_us_filled",
    lambda s, p: rounds(d.us(s, p), US_K),
    with_(US_LONG, US_RAW, US_FILLED, select=f"SELECT {rounded(US_K)} FROM usf"),
)
_p = d.US["P"]
add(
    "macro_us_index_series",
    lambda s, p: rounds(d.us(s, p, index_series="P"), US_K),
    with_(
        US_LONG,
        US_RAW,
        f'i AS (SELECT * FROM us WHERE "{_p}" IS NOT NULL)',
        US_FILLED.replace("FROM us)", "FROM i)"),
        select=f"SELECT {rounded(US_K)} FROM usf",
    ),
)
add(
    "macro_single_series",
    lambda s, p: rounds(
        src.single_series(d.macro_long(s, p, "o_orderpriority"), "1-URGENT"), {"date": None, "value": 5}
    ),
    with_(FX_LONG, select="SELECT date, round(value, 5) + 0.0 AS value FROM fx_long WHERE series = '1-URGENT'"),
)


def replies(s, p):
    """The FX table as yearly JSON replies; missing values are written as text."""
    wide = d.fx(s, p)
    fields = [F.coalesce(c(n).cast("string"), F.lit("ND")).alias(n) for n in d.FX.values()]
    item = F.struct(F.date_format("date", "dd-MM-yyyy").alias("Tarih"), *fields, F.lit(None).cast("string").alias("NONE"))
    years = wide.groupBy(F.year("date").alias("year")).agg(F.collect_list(item).alias("items"))
    return years.select("year", F.to_json(F.struct("items")).alias("json"))


add(
    "macro_json",
    lambda s, p: rounds(src.parse_macro(replies(s, p), [*d.FX.values(), "NONE"]), FX_K),
    with_(FX_LONG, FX, select=f"SELECT {rounded(FX_K)} FROM fx"),
)
SHORT = dict(zip(d.FX.values(), ["usd_buy", "usd_sell", "eur_buy", "eur_sell", "gbp_buy"]))
SHORT_K = {"date": None, **{v: 5 for v in SHORT.values()}}
add(
    "macro_json_renamed",
    lambda s, p: rounds(src.parse_macro(replies(s, p), list(d.FX.values()), SHORT), SHORT_K),
    with_(
        FX_LONG,
        FX,
        select="SELECT date, " + ", ".join(f'round("{k}", 5) + 0.0 AS {v}' for k, v in SHORT.items()) + " FROM fx",
    ),
)


def chunks(s, p):
    wide = d.fx(s, p)
    later = wide.filter(c("date") >= "1998-06-01").withColumn("TP_DK_USD_A_YTL", c("TP_DK_USD_A_YTL") * 2)
    return [wide.filter(c("date") < "1999-01-01"), later]


CHUNK_K = {"date": None, "TP_DK_USD_A_YTL": 5, "TP_DK_USD_S_YTL": 5}
add(
    "macro_chunks_keep_last",
    lambda s, p: rounds(src.merge_chunks(chunks(s, p)), CHUNK_K),
    with_(
        FX_LONG,
        FX,
        """x AS (SELECT date, CASE WHEN date >= DATE '1998-06-01' THEN 2 ELSE 1 END * "TP_DK_USD_A_YTL" AS "TP_DK_USD_A_YTL",
        "TP_DK_USD_S_YTL" FROM fx)""",
        select=f"SELECT {rounded(CHUNK_K)} FROM x",
    ),
)
add(
    "macro_chunks_union",
    lambda s, p: rounds(src.union_chunks(chunks(s, p)), {**CHUNK_K, "_chunk": None}),
    with_(
        FX_LONG,
        FX,
        """x AS (SELECT date, "TP_DK_USD_A_YTL", "TP_DK_USD_S_YTL", 0 AS _chunk FROM fx WHERE date < DATE '1999-01-01'
        UNION ALL SELECT date, 2 * "TP_DK_USD_A_YTL", "TP_DK_USD_S_YTL", 1 FROM fx WHERE date >= DATE '1998-06-01')""",
        select=f"SELECT {rounded({**CHUNK_K, '_chunk': None})} FROM x",
    ),
)
add(
    "macro_frequency_merge",
    lambda s, p: rounds(macro.merge_frequencies(d.fx(s, p), d.us(s, p)), {**FX_K, **US_K}),
    with_(FX_LONG, FX, US_LONG, US_RAW, US_FILLED,
          select=f"SELECT {rounded({**FX_K, **US_K})} FROM fx FULL JOIN usf USING (date)"),
)

JOIN_K = {"symbol": None, "date": None, **{v: 5 for v in d.FX.values()}}
FX_JOINED = (
    "fxj AS (SELECT b.*, "
    + ", ".join(f'{ffill("f." + chr(34) + v + chr(34), "PARTITION BY b.symbol ORDER BY b.date")} AS "{v}"' for v in d.FX.values())
    + " FROM bars b LEFT JOIN fx f USING (date))"
)
add(
    "macro_join_forward_filled",
    lambda s, p: rounds(macro.join_macro(d.bars(s, p), d.fx(s, p)), JOIN_K),
    with_(BARS, FX_LONG, FX, FX_JOINED, select=f"SELECT {rounded(JOIN_K)} FROM fxj"),
)
FX_FILLED = (
    "fxf AS (SELECT date, " + ", ".join(f'{ffill(chr(34) + v + chr(34), DAY)} AS "{v}"' for v in d.FX.values()) + " FROM fx)"
)
add(
    "macro_join_asof",
    lambda s, p: rounds(macro.join_macro(d.bars(s, p), d.fx(s, p), mode="asof"), JOIN_K),
    with_(BARS, FX_LONG, FX, FX_FILLED,
          "j AS (SELECT b.symbol, b.date, f.* EXCLUDE (date) FROM bars b ASOF LEFT JOIN fxf f ON b.date >= f.date)",
          select=f"SELECT {rounded(JOIN_K)} FROM j"),
)
US_JOIN_K = {"symbol": None, "date": None, **{v: 5 for v in d.US.values()}}


def us_joined(bars="bars", backfill=True):
    filled = ", ".join(
        f'{ffill("f." + chr(34) + v + chr(34), "PARTITION BY b.symbol ORDER BY b.date")} AS "{v}"' for v in d.US.values()
    )
    out = [f"usj0 AS (SELECT b.*, {filled} FROM {bars} b LEFT JOIN usf f USING (date))"]
    if backfill:
        back = ", ".join(
            f'first_value("{v}" IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS "{v}"'
            for v in d.US.values()
        )
        out.append(f"usj AS (SELECT * REPLACE ({back}) FROM usj0)")
    return ",\n".join(out)


add(
    "us_macro_join_backfilled",
    lambda s, p: rounds(macro.add_us_macro(d.bars(s, p), d.us(s, p), backfill=True), US_JOIN_K),
    with_(BARS, US_LONG, US_RAW, US_FILLED, us_joined(), select=f"SELECT {rounded(US_JOIN_K)} FROM usj"),
)
FXF = {
    "USD_spread": 4, "USD_change": 6, "USD_change_5d": 6, "USD_sma_7": 4, "USD_volatility": 6, "EUR_USD_ratio": 6,
    "close_usd": 8, "close_usd_change": 6,
}
FX_FEATURES = f"""fx1 AS (SELECT *, "TP_DK_USD_S_YTL" - "TP_DK_USD_A_YTL" AS "USD_spread", {pct('"TP_DK_USD_A_YTL"')} AS "USD_change",
  {pct('"TP_DK_USD_A_YTL"', 5)} AS "USD_change_5d", {roll('avg', '"TP_DK_USD_A_YTL"', 7)} AS "USD_sma_7",
  "TP_DK_EUR_A_YTL" / "TP_DK_USD_A_YTL" AS "EUR_USD_ratio", close / "TP_DK_USD_A_YTL" AS close_usd FROM fxj),
fx2 AS (SELECT *, {roll('stddev_samp', '"USD_change"', 14)} AS "USD_volatility", {pct('close_usd')} AS close_usd_change FROM fx1)"""
add(
    "fx_features",
    lambda s, p: rounds(macro.add_macro(d.bars(s, p), d.fx(s, p)), {"symbol": None, "date": None, **FXF}),
    with_(BARS, FX_LONG, FX, FX_JOINED, FX_FEATURES,
          select=f"SELECT {rounded({'symbol': None, 'date': None, **FXF})} FROM fx2"),
)

DERIVED = {
    "usd_spread": 5, "eur_usd_cross": 6, "gold_try_pct": 4, "usd_try_pct": 4, "usd_try_ma5": 4, "usd_try_ma20": 4,
    "usd_try_vol10": 4, "real_rate": 5, "trade_balance": 5, "fx_gold_total_res": 5,
}
FX_SHORT = {
    "1-URGENT": "usd_buy", "2-HIGH": "usd_sell", "3-MEDIUM": "eur_buy", "4-NOT SPECIFIED": "gold_try", "5-LOW": "policy_rate",
}
US_SHORT = {"F": "cpi_yoy", "O": "exports", "P": "imports"}


def derived(s, p):
    fx = macro.to_wide(d.macro_long(s, p, "o_orderpriority"), FX_SHORT)
    us = macro.to_wide(d.macro_long(s, p, "o_orderstatus"), US_SHORT)
    both = macro.merge_frequencies(fx, us).withColumns({"fx_reserves": c("exports") * 2, "gold_reserves": c("imports")})
    return rounds(macro.macro_derived(both), {"date": None, **DERIVED})


add(
    "macro_derived_features",
    derived,
    with_(
        FX_LONG,
        wide_sql("fx", FX_SHORT),
        US_LONG,
        wide_sql("us", US_SHORT),
        "m AS (SELECT * FROM fx FULL JOIN us USING (date))",
        f"""f AS (SELECT *, {ffill('usd_buy', DAY)} AS u, {ffill('gold_try', DAY)} AS g, {ffill('policy_rate', DAY)} AS pr,
        {ffill('cpi_yoy', DAY)} AS cy FROM m)""",
        f"g AS (SELECT *, {pct('u', 1, DAY)} AS chg, {pct('g', 1, DAY)} AS gchg FROM f)",
        f"""x AS (SELECT date, usd_sell - usd_buy AS usd_spread, eur_buy / usd_buy AS eur_usd_cross, gchg * 100 AS gold_try_pct,
        chg * 100 AS usd_try_pct, {roll('avg', 'usd_buy', 5, DAY)} AS usd_try_ma5, {roll('avg', 'usd_buy', 20, DAY)} AS usd_try_ma20,
        {roll('stddev_samp', 'chg', 10, DAY)} * 100 AS usd_try_vol10, pr - cy AS real_rate, exports - imports AS trade_balance,
        exports * 2 + imports AS fx_gold_total_res FROM g)""",
        select=f"SELECT {rounded({'date': None, **DERIVED})} FROM x",
    ),
)

# -- sentiment on bars -------------------------------------------------------------------------

SENT = {"avg_sentiment": 6, "news_count": None, **{f"sentiment_{n}d": 6 for n in (7, 14, 30, 50)}}


def sentiment_sql(bars="bars"):
    means = ", ".join(f"coalesce({roll('avg', 'avg_sentiment', n)}, 0) AS sentiment_{n}d" for n in (7, 14, 30, 50))
    return f"""sj AS (SELECT b.*, coalesce(s.avg_sentiment, 0) AS avg_sentiment, coalesce(s.news_count, 0) AS news_count
    FROM {bars} b LEFT JOIN daily s USING (symbol, date)),
    sent AS (SELECT *, {means} FROM sj)"""


add(
    "sentiment_features",
    lambda s, p: rounds(sentiment.add_sentiment(d.bars(s, p), d.daily(s, p)), {"symbol": None, "date": None, **SENT}),
    with_(BARS, SCORED, sentiment_sql(), select=f"SELECT {rounded({'symbol': None, 'date': None, **SENT})} FROM sent"),
)

# -- the whole pipeline -----------------------------------------------------------------------------

FULL = {
    "symbol": None, "date": None, "target": None, "SMA_50": 4, "MACD_hist": 4, "RSI_14": 4, "ATR_14": 4, "Stoch_D": 4,
    "OBV": None, "VWAP": 4, "MFI_14": 4, "Force_13": 2, "TSI": 4, "pct_from_52w_high": 6, "return_lag_5": 6,
    "USD_volatility": 6, "close_usd_change": 6, "Fed Faiz Oranı": 5, "2Y Tahvil Faizi": 5, "avg_sentiment": 6,
    "sentiment_30d": 6,
}


def full_sql(tail, target=TARGET):
    return f"""ind AS (SELECT *, {target} AS target, "MACD" - "MACD_signal" AS "MACD_hist",
    100 - (100 / (1 + pos14 / (neg14 + 1e-10))) AS "MFI_14", 100 * pc2 / (ab2 + 1e-10) AS "TSI",
    close / high252 - 1 AS pct_from_52w_high, {lag('return_1d', 5)} AS return_lag_5 FROM t5),
    {tail}"""


COMPLETE = " AND ".join(
    f'"{n}" IS NOT NULL'
    for n in [
        "SMA_50", "RSI_14", "ATR_14", "Stoch_D", "MFI_14", "TSI", "Force_13", "pct_from_52w_high", "return_lag_5",
        *d.FX.values(), "USD_volatility", "USD_sma_7", "close_usd_change", *d.US.values(),
    ]
)


def full(s, p):
    df = features.build_features(d.bars(s, p), d.fx(s, p), d.us(s, p), d.daily(s, p), min_rows=200)
    return rounds(df, FULL)


add(
    "feature_pipeline",
    full,
    with_(
        *TECH, FX_LONG, FX, US_LONG, US_RAW, US_FILLED, SCORED,
        full_sql(FX_JOINED.replace("FROM bars b", "FROM ind b")),
        FX_FEATURES,
        us_joined("fx2", backfill=False),
        sentiment_sql("usj0"),
        f"done AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM sent WHERE {COMPLETE})",
        select=f"SELECT {rounded(FULL)} FROM done WHERE n >= 200",
    ),
)
FX_COMPLETE = " AND ".join(f'"{n}" IS NOT NULL' for n in [*d.FX.values(), *FXF])
add(
    "feature_pipeline_macro_first",
    lambda s, p: rounds(
        features.build_features_macro_first(d.bars(s, p), d.fx(s, p), d.us(s, p), d.daily(s, p)), FULL
    ),
    with_(
        BARS, FX_LONG, FX, US_LONG, US_RAW, US_FILLED, SCORED, FX_JOINED, FX_FEATURES,
        f"bx AS (SELECT * FROM fx2 WHERE {FX_COMPLETE})",
        sentiment_sql("bx"),
        TECH[1].replace("FROM bars", "FROM sent"), *TECH[2:],
        full_sql(
            """cmp AS (SELECT * EXCLUDE (target) FROM ind WHERE "SMA_50" IS NOT NULL AND "RSI_14" IS NOT NULL
            AND "Stoch_D" IS NOT NULL AND pct_from_52w_high IS NOT NULL AND "TSI" IS NOT NULL AND "MFI_14" IS NOT NULL)"""
        ),
        us_joined("cmp"),
        f"fin AS (SELECT *, {TARGET} AS target FROM usj)",
        select=f"SELECT {rounded(FULL)} FROM fin",
    ),
)
