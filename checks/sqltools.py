"""Pieces of DuckDB SQL shared by the oracles."""

from __future__ import annotations

W = "PARTITION BY symbol ORDER BY date"

BARS = """
li AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber,
         l_partkey, l_extendedprice, l_quantity, l_extendedprice / l_quantity AS p, l_discount AS dc, l_tax AS tx
  FROM lineitem),
bars AS (
  SELECT symbol, date,
         first(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS open,
         max(p * (1 + tx)) AS high,
         min(p * (1 - dc)) AS low,
         last(p * (1 - dc) * (1 + tx)
              ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS close,
         sum(l_quantity) AS volume
  FROM li GROUP BY symbol, date)
"""


def over(n: int | None = None, w: str = W) -> str:
    """Window of the last n rows, or of all rows so far."""
    start = "UNBOUNDED" if n is None else str(n - 1)
    return f"OVER ({w} ROWS BETWEEN {start} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int, w: str = W) -> str:
    return f"CASE WHEN count({x}) {over(n, w)} = {n} THEN {f}({x}) {over(n, w)} END"


def lag(x: str, k: int = 1, w: str = W) -> str:
    return f"lag({x}, {k}) OVER ({w})"


def pct(x: str, k: int = 1, w: str = W) -> str:
    return f"({x} / {lag(x, k, w)} - 1)"


def ffill(x: str, w: str = W) -> str:
    return f"last_value({x} IGNORE NULLS) {over(None, w)}"


def ewm(x: str, span: int, first: int = 1) -> str:
    """Recursive mean of a column without gaps from row ``first`` (rn) on."""
    a = 2 / (span + 1)
    d = 1 - a
    t = f"(rn - {first})"
    return (
        f"CASE WHEN rn >= {first} THEN pow({d!r}, {t}) * sum(CASE WHEN rn < {first} THEN 0 WHEN rn = {first} THEN {x} "
        f"ELSE {a!r} * {x} * pow({d!r}, -{t}) END) {over()} END"
    )


def ewm_adjusted(x: str, span: int) -> str:
    """Weighted mean with weights (1-a)^age over the non-null rows."""
    d = 1 - 2 / (span + 1)
    weight = f"CASE WHEN {x} IS NOT NULL THEN pow({d!r}, -rn) END"
    return f"sum({x} * pow({d!r}, -rn)) {over()} / sum({weight}) {over()}"


def rounded(digits: dict[str, int | None]) -> str:
    """Select list: doubles rounded, other columns as they are."""
    return ", ".join(
        f'"{n}"' if d is None else f'round("{n}", {d}) + 0.0 AS "{n}"' for n, d in digits.items()
    )


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(x.strip() for x in ctes) + "\n" + select
