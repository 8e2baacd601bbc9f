import datetime as dt

import pytest

from freshet.functions.dialect import register
from freshet.plans import program
from freshet.streaming.engine import Engine

EXPRESSIONS = [
    ("CONCAT('a', NULL, 'b')", "ab"),
    ("SUBSTR('hello', -1, 4)", "he"),
    ("SUBSTRING('hello', 2)", "ello"),
    ("STRPOS('abc', 'c')", 3),
    ("SPLIT_INDEX('a.b', '.', 1)", "b"),
    ("SPLIT_PART('a.b', '.', 0)", ""),
    ("LOG(1000)", 3.0),
    ("LOG(2, 8)", 3.0),
    ("SIGN(-4)", -1),
    ("IIF(1 > 2, 'x', 'y')", "y"),
    ("TRIM('xxaxx', 'x')", "a"),
    ("LTRIM('xxaxx', 'x')", "axx"),
    ("RTRIM('a  ')", "a"),
    ("REGEXP_REPLACE('aaa', 'a', 'b')", "baa"),
    ("REGEXP_REPLACE('aAa', 'a', 'b', 'gi')", "bbb"),
    ("REGEXP_LIKE('ABC', 'b', 'i')", True),
    ("'abc' SIMILAR TO 'a%|x'", True),
    ("'abc' SIMILAR TO 'b_'", False),
    ("DATEDIFF('year', TIMESTAMP_NTZ '2023-12-31 00:00:00', TIMESTAMP_NTZ '2024-01-01 00:00:00')", 1),
    ("DATEDIFF('month', DATE '2023-12-31', DATE '2024-02-01')", 2),
    ("DATEDIFF('week', DATE '2024-01-07', DATE '2024-01-08')", 1),
    ("DATEDIFF('hour', TIMESTAMP_NTZ '2024-01-01 00:59:00', TIMESTAMP_NTZ '2024-01-01 01:00:00')", 1),
    ("DATEADD('month', 1, TIMESTAMP_NTZ '2024-01-31 00:00:00')", dt.datetime(2024, 2, 29)),
    ("EXTRACT(DOW FROM TIMESTAMP_NTZ '2024-01-07 00:00:00')", 0),
    ("TUMBLE_START(TIMESTAMP_NTZ '2024-01-07 10:31:00', INTERVAL '15' MINUTE)", dt.datetime(2024, 1, 7, 10, 30)),
    ("TUMBLE_END(TIMESTAMP_NTZ '2024-01-07 10:31:00', INTERVAL '15' MINUTE)", dt.datetime(2024, 1, 7, 10, 45)),
    ("UPPER(CONCAT('a', SUBSTR('xyz', 2, 1)))", "AY"),
]


@pytest.mark.parametrize("text,want", EXPRESSIONS)
def test_expressions(spark, text, want):
    register(spark)
    got = spark.sql(f"SELECT {program.translate(text)} AS x").first()[0]
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


TEXT = """
-- a program; of two tables
CREATE TABLE bid (auction BIGINT NOT NULL, price DECIMAL(10, 2), at TIMESTAMP NOT NULL LATENESS 10000000) WITH ('append_only' = 'true');
CREATE TABLE person (id INT PRIMARY KEY, who ROW(name VARCHAR(8), home ROW(city TEXT)));
CREATE VIEW per_minute AS SELECT auction, TUMBLE_START(at, INTERVAL '1' MINUTE) AS w, COUNT(*) AS n FROM bid GROUP BY auction, TUMBLE(at, INTERVAL '1' MINUTE);
CREATE VIEW hops AS SELECT auction, window_start FROM TABLE(HOP(TABLE bid, DESCRIPTOR(at), INTERVAL '30' SECOND, INTERVAL '1' MINUTE));
CREATE VIEW recent AS SELECT auction FROM bid WHERE at > NOW() - INTERVAL '1' MINUTE;
CREATE VIEW cities AS SELECT "who.home.city" AS city FROM person;
"""


def test_program(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    assert program.load(e, TEXT) == ["per_minute", "hops", "recent", "cities"]
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(seconds=s)
    e.push("bid", [(1, None, at(5)), (1, None, at(50)), (2, None, at(70))])
    e.push("person", [(1, "ann", "Oslo")])
    e.step()
    e.push("bid", [(3, None, at(59)), (3, None, at(60))])  # the frontier is at 60 seconds
    e.advance_clock(int(at(115).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6))
    e.step()
    assert e.dropped["bid"] == 1
    got = sorted((r.auction, r.w, r.n) for r in e.snapshot("per_minute").collect())
    assert got == [(1, at(0), 2), (2, at(60), 1), (3, at(60), 1)]
    assert sorted((r.auction, r.window_start) for r in e.snapshot("hops").where("auction = 1").collect()) == [(1, at(-30)), (1, at(0)), (1, at(0)), (1, at(30))]
    assert sorted(r.auction for r in e.snapshot("recent").collect()) == [2, 3]
    assert [r.city for r in e.snapshot("cities").collect()] == ["Oslo"]
    assert sorted((r.auction, r.n, r["__weight"]) for r in e.delta("per_minute").collect()) == [(3, 1, 1)]
    with pytest.raises(ValueError):
        e.push("bid", [(1, None, at(90))], -1)


QUERIES = [
    ("SELECT 7 / 2 AS a, -7 / 2 AS b, 7 / 2 / 2 AS c, 7.5D / 2 AS d, CAST(7 AS DOUBLE) / 2 AS e, CAST(7.9D AS INT) / 2 AS f FROM one", [(3, -3, 1, 3.75, 3.5, 3)]),
    ("SELECT 'abc' SIMILAR TO 'a.c' AS a, 'abc' SIMILAR TO 'a_c' AS b, 'x%' SIMILAR TO '(x|y)!%' ESCAPE '!' AS c, 'a.c' SIMILAR TO 'a[.x]c' AS d FROM one", [(False, True, True, True)]),
    (r"SELECT REGEXP_REPLACE('abcb', '(b)', '[$1]') AS a, REGEXP_REPLACE('abab', '(a)(b)\1', '\2\&') AS b, REGEXP_REPLACE('aXbx', 'x', '-', 'gi') AS c FROM one", [("a[$1]cb", "babab", "a-b-")]),
    ("SELECT LN(0) AS a, LN(NULL) AS b, FLOOR(2.5D) AS c, CEIL(-2.5D) AS d, FLOOR(7) AS e, UPPER('straße') AS f FROM one", [(float("-inf"), None, 2.0, -2.0, 7, "STRAßE")]),
    ("SELECT DATE_TRUNC('month', DATE '2024-03-15') AS a, DATEADD('day', 20, DATE '2024-03-15') AS b, DATE_TRUNC('hour', TIMESTAMP_NTZ '2024-03-15 10:20:30') AS c FROM one", [(dt.date(2024, 3, 1), dt.date(2024, 4, 4), dt.datetime(2024, 3, 15, 10))]),
    ("SELECT x, LAST_VALUE(x) OVER (ORDER BY x DESC) AS l, ROW_NUMBER() OVER (ORDER BY x) AS r FROM some ORDER BY x", [(1, 1, 1), (2, 1, 2), (None, 1, 3)]),
    ("SELECT 1 IN (SELECT x FROM some) AS a, 5 IN (SELECT x FROM some) AS b, 5 NOT IN (SELECT x FROM some) AS c, 5 NOT IN (SELECT x FROM some WHERE x > 0) AS d FROM one", [(True, None, None, True)]),
    ("SELECT x FROM some ORDER BY x DESC OFFSET 1 ROW FETCH FIRST 1 ROW ONLY", [(2,)]),
    ("SELECT 'it''s' AS a, 'x\\y' AS b FROM one", [("it's", "x\\y")]),
    ("WITH RECURSIVE r(a, b) AS (SELECT x, x % 2 + 1 FROM some WHERE x IS NOT NULL UNION ALL SELECT p.a, q.b FROM r p JOIN r q ON p.b = q.a), n AS (SELECT count(*) AS c FROM r) SELECT c FROM n", [(4,)]),
]


@pytest.mark.parametrize("text,want", QUERIES)
def test_queries(spark, text, want):
    """Where the dialect's meaning is another than Spark's."""
    spark.sql("SELECT 1 AS one").createOrReplaceTempView("one")
    spark.createDataFrame([(2,), (None,), (1,)], "x int").createOrReplaceTempView("some")
    assert [tuple(r) for r in program.query(spark, text).collect()] == want


@pytest.mark.parametrize("bad", ["DROP TABLE t", "CREATE TABLE t (a BLOB)", "CREATE TABLE t (a INT) WITH ('x' = 'y')"])
def test_rejects(spark, tmp_path, bad):
    with pytest.raises(ValueError):
        program.load(Engine(spark, str(tmp_path / "s")), bad)
