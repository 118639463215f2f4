"""Macro series joined to bars, and features derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.numeric import div
from tickerloom.operators import timeseries as ts
from tickerloom.operators.stacks import tools

c = F.col

# FX columns as the rate service names them.
FX_COLUMNS = [
    "TP_DK_USD_A_YTL", "TP_DK_USD_S_YTL",
    "TP_DK_EUR_A_YTL", "TP_DK_EUR_S_YTL",
    "TP_DK_GBP_A_YTL", "TP_DK_CHF_A_YTL",
    "TP_DK_JPY_A_YTL",
]

# US series codes and their column names.
US_SERIES = {
    "FEDFUNDS": "Fed Faiz Oranı",
    "DGS10": "10Y Tahvil Faizi",
    "DGS2": "2Y Tahvil Faizi",
    "T10Y2Y": "Yield Curve (10Y-2Y spread)",
    "VIXCLS": "VIX (volatilite endeksi)",
    "DCOILWTICO": "Ham Petrol Fiyatı",
    "DEXUSEU": "EUR/USD",
    "DEXCHUS": "USD/CNY",
    "UMCSENT": "Tüketici Güven Endeksi",
    "TEDRATE": "TED Spread (kredi riski)",
}
USD_BUY, USD_SELL, EUR_BUY = "TP_DK_USD_A_YTL", "TP_DK_USD_S_YTL", "TP_DK_EUR_A_YTL"


def q(name: str):
    return c(f"`{name}`")


def to_wide(macro: DataFrame, names: dict[str, str] | list[str]) -> DataFrame:
    """S-7: macro(series, date, value) to one row per date and one column per series."""
    names = names if isinstance(names, dict) else {n: n for n in names}
    wide = macro.filter(c("series").isin(list(names))).groupBy("date").pivot("series", list(names)).agg(F.max("value"))
    return wide.select("date", *[q(k).alias(v) for k, v in names.items()])


def fill_calendar(wide: DataFrame) -> DataFrame:
    """W-12 on a macro table: at most one row per day, so one ordered pass is small."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return wide.withColumns({n: F.last(q(n), ignorenulls=True).over(w) for n in wide.columns if n != "date"})


def us_series(macro: DataFrame, names: dict[str, str] = US_SERIES, index_series: str | None = None) -> DataFrame:
    """S-7: all series side by side, sorted and forward-filled.

    By default on the union of their dates; with ``index_series`` only on the
    dates of that series (what a column-by-column assignment gives).
    """
    wide = to_wide(macro, names)
    if index_series is not None:
        wide = wide.filter(q(names[index_series]).isNotNull())
    return fill_calendar(wide)


def merge_frequencies(daily: DataFrame, monthly: DataFrame) -> DataFrame:
    """J-5."""
    return daily.join(monthly, "date", "full_outer")


def join_macro(bars: DataFrame, wide: DataFrame, mode: str = "equi_ffill", backfill: bool = False) -> DataFrame:
    """J-3: macro columns on trading days.

    ``equi_ffill`` joins equal dates and fills forward over the symbol's rows,
    so a value of a day without trading is lost. ``asof`` keeps it.
    """
    names = [n for n in wide.columns if n != "date"]
    if mode == "asof":
        return asof_join(bars, wide, names)
    return fill_beside(beside(bars, wide, "_m_"), names, "_m_", backfill)


def beside(bars: DataFrame, wide: DataFrame, prefix: str) -> DataFrame:
    """The macro columns of equal dates, named by their place behind ``prefix``."""
    names = [n for n in wide.columns if n != "date"]
    side = wide.select("date", *[q(n).alias(f"{prefix}{i}") for i, n in enumerate(names)])
    return bars.join(side, "date", "left").select(*[q(n) for n in bars.columns], *side.drop("date").columns)


def fill_beside(df: DataFrame, names: list[str], prefix: str, backfill: bool = False) -> DataFrame:
    """Macro columns that ``beside`` has joined, under their names and filled over the symbol's rows."""
    _, c = tools(df)
    found = [f"{prefix}{i}" for i in range(len(names))]
    keep = [n for n in df.columns if n not in {*found, *names}]
    df = df.withColumns({n: ts.ffill(c(x)) for n, x in zip(names, found)})
    if backfill:
        df = df.withColumns({n: ts.bfill(c(f"`{n}`")) for n in names})
    return df.select(*[c(f"`{n}`") for n in [*keep, *names]])


def asof_join(bars: DataFrame, wide: DataFrame, names: list[str]) -> DataFrame:
    """J-10: the last value of each column at or before the bar's date.

    The macro table is first filled over its own dates; a bar then needs the row
    of the greatest macro date up to its own, found in the table of intervals
    expanded to days. That table has one row per calendar day.
    """
    filled = fill_calendar(wide)
    nxt = F.lead("date").over(Window.orderBy("date"))
    end = F.greatest(filled.agg(F.max("date")).scalar(), bars.agg(F.max("date")).scalar())
    days = (
        filled.withColumn("_next", nxt)
        .withColumn("_to", F.coalesce(F.date_sub("_next", 1), end))
        .withColumn("_day", F.explode(F.sequence("date", "_to")))
        .select(c("_day").alias("date"), *[q(n) for n in names])
    )
    return bars.join(days, "date", "left").select(
        *[bars[f"`{n}`"] for n in bars.columns], *[q(n) for n in names]
    )


def add_fx_features(df: DataFrame) -> DataFrame:
    """D-39 to D-42, for the FX columns that are present."""
    have, keep, new = set(df.columns), df.columns, []
    _, c = tools(df)

    def add(layer: dict) -> None:
        nonlocal df
        df = df.withColumns(layer)
        new.extend(n for n in layer if not n.startswith("_"))

    first = {}
    if {USD_BUY, USD_SELL} <= have:
        first["USD_spread"] = c(USD_SELL) - c(USD_BUY)
    if USD_BUY in have:
        usd = c(USD_BUY)
        first |= {"_usd": ts.ffill(usd), "USD_sma_7": ts.roll_mean(usd, 7), "close_usd": div(c("close"), usd)}
    if {USD_BUY, EUR_BUY} <= have:
        first["EUR_USD_ratio"] = div(c(EUR_BUY), c(USD_BUY))
    add(first)
    if USD_BUY in have:
        add({
            "USD_change": ts.pct_change(c("_usd"), 1),
            "USD_change_5d": ts.pct_change(c("_usd"), 5),
            "_close_usd": ts.ffill(c("close_usd")),
        })
        add({
            "USD_volatility": ts.roll_std(c("USD_change"), 14),
            "close_usd_change": ts.pct_change(c("_close_usd"), 1),
        })
    return df.select(*[c(f"`{n}`") for n in keep], *new)


def add_macro(df: DataFrame, wide: DataFrame | None) -> DataFrame:
    """D-38 to D-42."""
    side = fx_columns(wide)
    return df if side is None else add_fx_features(join_macro(df, side))


def fx_columns(wide: DataFrame | None) -> DataFrame | None:
    """The FX columns of a macro table, if it has any."""
    names = [n for n in FX_COLUMNS if wide is not None and n in wide.columns]
    return wide.select("date", *[q(n) for n in names]) if names else None


def add_us_macro(df: DataFrame, wide: DataFrame | None, backfill: bool = False) -> DataFrame:
    """D-43."""
    return df if wide is None else join_macro(df, wide, backfill=backfill)


def macro_derived(wide: DataFrame) -> DataFrame:
    """D-44 on a wide macro table (one row per date), for the columns that are present."""
    have = set(wide.columns)
    w = Window.orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    def filled(n):
        return F.last(c(n), ignorenulls=True).over(upto)

    def mean(x, n):
        f = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count(x).over(f) == n, F.avg(x).over(f))

    def pct(n):
        return div(c(f"_{n}"), F.lag(f"_{n}").over(w)) - 1

    keep = wide.columns
    df = wide.withColumns({f"_{n}": filled(n) for n in ("usd_buy", "gold_try", "policy_rate", "cpi_yoy") if n in have})
    out = {}
    if {"usd_buy", "usd_sell"} <= have:
        out["usd_spread"] = c("usd_sell") - c("usd_buy")
    if {"eur_buy", "usd_buy"} <= have:
        out["eur_usd_cross"] = div(c("eur_buy"), c("usd_buy"))
    if "gold_try" in have:
        out["gold_try_pct"] = pct("gold_try") * 100
    if "usd_buy" in have:
        df = df.withColumn("_chg", pct("usd_buy"))
        f10 = w.rowsBetween(-9, 0)
        out |= {
            "usd_try_pct": c("_chg") * 100,
            "usd_try_ma5": mean(c("usd_buy"), 5),
            "usd_try_ma20": mean(c("usd_buy"), 20),
            "usd_try_vol10": F.when(F.count("_chg").over(f10) == 10, F.stddev_samp("_chg").over(f10)) * 100,
        }
    if {"policy_rate", "cpi_yoy"} <= have:
        out["real_rate"] = c("_policy_rate") - c("_cpi_yoy")
    if {"exports", "imports"} <= have:
        out["trade_balance"] = c("exports") - c("imports")
    if {"fx_reserves", "gold_reserves"} <= have:
        out["fx_gold_total_res"] = c("fx_reserves") + c("gold_reserves")
    return df.withColumns(out).select(*keep, *out)
