"""Macro series from the JSON replies of a rate service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.numeric import finite

c = F.col

# Fixed value: name of the date field in the replies.
DATE_FIELD = "Tarih"


def parse_macro(raw: DataFrame, names: list[str], rename: dict[str, str] | None = None, drop_empty: bool = True) -> DataFrame:
    """S-5, S-6: replies(json) to one row per date with numeric columns.

    Dates are day-first, values that are no numbers become null, and columns
    without any value are dropped.
    """
    schema = "items array<map<string,string>>"
    items = raw.select(F.explode(F.from_json("json", schema)["items"]).alias("i"))
    # Day-first, also when written as year-month only (monthly series).
    text = c("i")[DATE_FIELD]
    date = F.coalesce(
        F.to_date(F.try_to_timestamp(text, F.lit("dd-MM-yyyy"))),
        F.to_date(F.try_to_timestamp(text, F.lit("yyyy-M"))),
    )
    df = items.select(date.alias("date"), *[finite(F.try_element_at("i", F.lit(n)).try_cast("double")).alias(n) for n in names])
    if drop_empty:
        counts = df.agg(*[F.count(f"`{n}`").alias(n) for n in names]).first()
        df = df.select("date", *[f"`{n}`" for n in names if counts[n] > 0])
    return df.withColumnsRenamed(rename or {})


def single_series(macro: DataFrame, series: str) -> DataFrame:
    """S-6: one series as (date, value)."""
    return macro.filter(c("series") == series).select("date", "value")


def union_chunks(chunks: list[DataFrame]) -> DataFrame:
    """E-1: chunks one below the other, tagged with their order."""
    out = None
    for i, chunk in enumerate(chunks):
        part = chunk.withColumn("_chunk", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def merge_chunks(chunks: list[DataFrame]) -> DataFrame:
    """D-47: yearly chunks; a date that occurs twice keeps the row of the last chunk."""
    both = union_chunks(chunks)
    rest = [n for n in both.columns if n not in ("date", "_chunk")]
    row = F.struct(*[c(f"`{n}`") for n in rest])
    return both.groupBy("date").agg(F.max_by(row, "_chunk").alias("_r")).select("date", "_r.*")


# The extended catalogue (short name, series code, label, frequency).
CATALOGUE = [
    ("usd_buy", "TP.DK.USD.A.YTL", "USD Alış (TRY)", "daily"),
    ("usd_sell", "TP.DK.USD.S.YTL", "USD Satış (TRY)", "daily"),
    ("eur_buy", "TP.DK.EUR.A.YTL", "EUR Alış (TRY)", "daily"),
    ("eur_sell", "TP.DK.EUR.S.YTL", "EUR Satış (TRY)", "daily"),
    ("gbp_buy", "TP.DK.GBP.A.YTL", "GBP Alış (TRY)", "daily"),
    ("chf_buy", "TP.DK.CHF.A.YTL", "CHF Alış (TRY)", "daily"),
    ("jpy_buy", "TP.DK.JPY.A.YTL", "JPY Alış (TRY)", "daily"),
    ("gold_try", "TP.DK.XAU.A.YTL", "Altın (TRY/ons)", "daily"),
    ("gold_usd", "TP.DK.XAU.A", "Altın (USD/ons)", "daily"),
    ("policy_rate", "TP.MB.B.C", "TCMB Politika Faizi", "monthly"),
    ("overnight_borrow", "TP.MB.B.A", "Gecelik Borçlanma Faizi", "monthly"),
    ("overnight_lend", "TP.MB.B.B", "Gecelik Borç Verme Faizi", "monthly"),
    ("cpi_total", "TP.FG.J0", "TÜFE Genel (Aylık % Değişim)", "monthly"),
    ("cpi_yoy", "TP.FG.J01", "TÜFE Genel (Yıllık % Değişim)", "monthly"),
    ("ppi_total", "TP.FG.J02", "ÜFE Genel (Aylık % Değişim)", "monthly"),
    ("exports", "TP.DIE.IHRIX01", "İhracat (Milyon USD)", "monthly"),
    ("imports", "TP.DIE.ITHALAT", "İthalat (Milyon USD)", "monthly"),
    ("fx_reserves", "TP.AB.B1", "Brüt Döviz Rezervleri (Milyon USD)", "monthly"),
    ("gold_reserves", "TP.AB.B3", "Altın Rezervleri (Milyon USD)", "monthly"),
    ("current_account", "TP.OB.CA", "Cari Denge (Milyon USD)", "monthly"),
]


def catalogue(spark: SparkSession) -> DataFrame:
    """The catalogue as a table to join or rename against."""
    return spark.createDataFrame(CATALOGUE, "series string, code string, label string, freq string")


def reply_names(freq: str) -> dict[str, str]:
    """Reply column to short name: replies write the code with underscores."""
    return {code.replace(".", "_"): short for short, code, _, f in CATALOGUE if f == freq}
