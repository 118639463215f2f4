import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tickerloom.session import local_session

    session = local_session(8, "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_bars(spark):
    """Bars of one or more symbols from closes; the other columns follow from them."""
    import datetime as dt

    def make(closes, **columns):
        groups = closes if isinstance(closes, dict) else {"A": closes}
        rows = []
        for symbol, values in groups.items():
            for i, close in enumerate(values):
                row = {"open": close, "high": close, "low": close, "close": close, "volume": 1.0}
                row.update({k: float(v[i]) for k, v in columns.items()})
                rows.append(
                    (symbol, dt.date(2020, 1, 1) + dt.timedelta(days=i), *[
                        None if row[n] is None else float(row[n]) for n in ("open", "high", "low", "close", "volume")
                    ])
                )
        return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")

    return make
