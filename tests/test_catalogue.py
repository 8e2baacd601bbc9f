import datetime
import decimal

import duckdb
import pytest

from freshet import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(got):
    return sorted((tuple(plain(v) for v in r) for r in got), key=repr)


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in catalogue.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_like_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.ORACLE_SQL[name]}) q").fetchall()
    assert rows(df.select(cols).collect()) == rows(want)


def test_estimates_are_near(spark, duck):
    exact = dict(duck.execute("SELECT event_type, count(DISTINCT user_id) FROM events GROUP BY event_type").fetchall())
    for r in catalogue.QUERIES["approx_count_distinct"](spark, SF).collect():
        assert abs(r.n - exact[r.event_type]) <= 0.06 * exact[r.event_type] + 1
    exact = dict(duck.execute("SELECT event_type, quantile_disc(value, 0.9) FROM events GROUP BY event_type").fetchall())
    for r in catalogue.QUERIES["approx_percentile"](spark, SF).collect():
        assert r.p == pytest.approx(exact[r.event_type], rel=0.05)
