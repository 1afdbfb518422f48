"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from sabitext.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return "NULL" if math.isnan(x) else f"{x:.9g}"
    return "NULL" if x is None else f"{x:.9g}" if isinstance(x, int) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = con.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    assert got == sorted(tuple(map(plain, r)) for r in want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_sentiment_fit_keeps_the_operators_defaults(spark, monkeypatch):
    from sabitext.operators import sentiment

    given = {}

    def fit(*args, **kwargs):
        given.update(kwargs)
        raise InterruptedError

    monkeypatch.setattr(sentiment, "fit", fit)
    with pytest.raises(InterruptedError):
        QUERIES["sentiment_fit"](spark, SF)
    assert set(given) == {"labels"} and sentiment.MOST_TERMS == 50_000


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
