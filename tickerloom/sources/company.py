"""Company list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the published list, its header row, and codes that
# match too many words to be of use.
CODE, NAME = "Kod", "Şirket Ünvanı"
HEADER_ROW = 3
BANNED_CODES = ["HEDEF"]


def read_company_list(spark: SparkSession, path: str, header_row: int = HEADER_ROW) -> DataFrame:
    """S-1: CSV export of the company list; lines before the header are notes."""
    raw = spark.read.option("header", False).csv(path).withColumn(
        "_line", F.monotonically_increasing_id()
    )
    # The list is one small file: its header is line ``header_row``.
    header = raw.filter(F.col("_line") == header_row - 1).first()
    names = {v: f"_c{i}" for i, v in enumerate(header) if v is not None}
    body = raw.filter(F.col("_line") >= header_row)
    return body.select(F.col(names[CODE]).alias("code"), F.col(names[NAME]).alias("name")).transform(usable_companies)


def usable_companies(companies: DataFrame, banned: list[str] | None = None) -> DataFrame:
    """S-1: companies with a name, without the banned codes."""
    banned = BANNED_CODES if banned is None else banned
    return companies.dropna(subset=["name"]).filter(~F.coalesce(F.col("code").isin(banned), F.lit(False)))


def company_id_of(company: DataFrame, code: str) -> DataFrame:
    """P-9."""
    return company.filter(F.col("code") == code).select("company_id")


def codes(company: DataFrame) -> DataFrame:
    """P-13."""
    return company.select("code")


def missing_sector(company: DataFrame, default: str) -> DataFrame:
    """P-8."""
    return company.filter(F.col("sector").isNull() | (F.col("sector") == default)).orderBy("code")
