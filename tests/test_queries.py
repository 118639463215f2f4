"""Queries against their SQL."""

import os

import pytest

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


def names():
    """The library's own queries; those of the corpus operators have tests of their own."""
    from checks import macro_checks, market, model_checks, news_checks

    return sorted(n for g in (market, macro_checks, news_checks, model_checks) for n in g.ORACLES)


@pytest.fixture(scope="module")
def con():
    from checks.compare import duck

    return duck(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    import __spark_entry__ as entry
    from checks.compare import compare

    verdict, *_ = compare(spark, con, SF_DIR, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict == "ok"


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
