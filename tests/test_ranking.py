import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql.classic.dataframe import DataFrame as ClassicDataFrame

from freshet import catalogue
from freshet.operators import ranking
from freshet.plans import program
from freshet.streaming.engine import Engine


def windows(df: DataFrame) -> list:
    """The windows of df's analysed plan that have no PARTITION BY."""
    found, open_ = [], [df._jdf.queryExecution().analyzed()]
    while open_:
        node = open_.pop()
        if node.nodeName() == "Window" and node.partitionSpec().isEmpty():
            found.append(node)
        open_ += [node.children().apply(i) for i in range(node.children().size())]
    return found


def most_in_one_task(df: DataFrame) -> int:
    """Rows that go through the largest window without PARTITION BY."""
    of = df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    return max((ClassicDataFrame(of(df.sparkSession._jsparkSession, w.child()), df.sparkSession).count() for w in windows(df)), default=0)


def rows(df: DataFrame) -> list:
    return sorted(map(repr, df.collect()))


def test_catalogue_ranks_leave_one_task(spark, tmp_path):
    spark.sql("SELECT id AS event_id, pmod(hash(id), 5000) AS user_id FROM range(20000)").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES["nulls_high"](spark, str(tmp_path))
    assert most_in_one_task(got) <= 1024
    spark.read.parquet(f"{tmp_path}/events.parquet").createOrReplaceTempView("events")
    want = spark.sql(program.translate(catalogue.DIALECT["nulls_high"][0]))
    assert most_in_one_task(want) == 20000
    assert got.schema == want.schema and rows(got) == rows(want)


FUNCTIONS = ("rank", "dense_rank", "percent_rank", "cume_dist")
ORDERS = ("a", "a DESC NULLS FIRST", "f", "s DESC, a", "a DESC, s NULLS LAST", "d, a % 3 DESC", "a + 1, i", "b, t")


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(5)
    values = [
        (
            i, r.choice([None, *range(-7, 9)]), r.choice([None, 0.0, -0.0, 1.5, -2.5, float("nan"), float("inf"), -float("inf")]), r.choice([None, "", "a", "A", "aa", "é", "\U0001f600", "z"]), r.choice([None, [1], [1, 2], []]), r.choice([True, False, None]),
        )
        for i in range(3000)
    ]
    spark.createDataFrame(values, "i bigint, a int, f double, s string, d array<int>, b boolean").selectExpr("*", "timestamp_micros(pmod(hash(i), 500)) AS t").createOrReplaceTempView("odd")
    spark.sql("SELECT * FROM odd WHERE false").createOrReplaceTempView("none")
    spark.sql("SELECT * FROM odd WHERE i = 7").createOrReplaceTempView("single")
    spark.sql("SELECT NULL AS i, CAST(NULL AS INT) AS a, * EXCEPT (i, a) FROM odd").createOrReplaceTempView("blank")


@pytest.mark.parametrize("order", ORDERS)
def test_odd_orders(spark, odd, order):
    made = ", ".join(f"{f}() OVER (ORDER BY {order}) AS c{i}" for i, f in enumerate(FUNCTIONS))
    df = spark.sql(f"SELECT i, {made} FROM odd")
    got = ranking.spread(df)
    assert most_in_one_task(df) == 3000 and most_in_one_task(got) <= 1024
    assert got.schema == df.schema and rows(got) == rows(df)


SHAPES = (
    "SELECT i, rank() OVER (ORDER BY a) AS x, dense_rank() OVER (ORDER BY a DESC) AS y, rank() OVER (ORDER BY s, i) AS z FROM odd WHERE a > 0",
    "SELECT * FROM (SELECT *, rank() OVER (ORDER BY a DESC, i) AS r FROM odd) q WHERE r BETWEEN 5 AND 9",
    "WITH t AS (SELECT i, a, rank() OVER (ORDER BY i) AS r FROM odd) SELECT p.i, q.r FROM t p JOIN t q ON p.r = q.r + 1",
    "WITH t AS (SELECT * FROM odd WHERE a IS NOT NULL) SELECT i, rank() OVER (ORDER BY a) AS r FROM t",
    "SELECT p.i, q.i AS i, rank() OVER (ORDER BY p.a, q.i) AS r FROM odd p LEFT JOIN odd q ON p.i + 2990 = q.i",
    "SELECT s, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM odd GROUP BY s",
    "SELECT rank() OVER (ORDER BY r) AS x FROM (SELECT rank() OVER (ORDER BY a) AS r FROM odd) q",
    "SELECT i, rank() OVER (ORDER BY a) AS r, count(*) OVER (PARTITION BY a) AS n, lag(i) OVER (PARTITION BY s ORDER BY i) AS l FROM odd",
    "SELECT i AS x, rank() OVER (ORDER BY a) AS r FROM odd UNION ALL SELECT a, dense_rank() OVER (ORDER BY i) FROM odd",
    "SELECT DISTINCT rank() OVER (ORDER BY a) AS r FROM odd ORDER BY r DESC LIMIT 3",
    *[f"SELECT *, {', '.join(f'{f}() OVER (ORDER BY a) AS c{i}' for i, f in enumerate(FUNCTIONS))} FROM {t}" for t in ("none", "single", "blank")],
)


@pytest.mark.parametrize("sql", SHAPES)
def test_shapes(spark, odd, sql):
    df = spark.sql(sql)
    got = ranking.spread(df)
    assert got is not df
    assert got.schema == df.schema and rows(got) == rows(df)


@pytest.mark.parametrize(
    "sql",
    (
        "SELECT i, rank() OVER (ORDER BY a) AS r FROM (SELECT * FROM odd LIMIT 5) q",
        "SELECT s, rank() OVER (ORDER BY sum(f)) AS r FROM odd GROUP BY s",
        "SELECT i, rank() OVER (ORDER BY x) AS r FROM (SELECT i, rand() AS x FROM odd) q",
        "SELECT i, row_number() OVER (ORDER BY i) AS r FROM odd",
        "SELECT i, rank() OVER (PARTITION BY a ORDER BY i) AS r FROM odd",
        "SELECT i, rank() OVER (ORDER BY i) AS r, lag(i) OVER (ORDER BY i) AS l FROM odd",
    ),
)
def test_what_may_differ_when_read_twice_stays(spark, odd, sql):
    df = spark.sql(sql)
    assert ranking.spread(df) is df


def test_views(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    program.load(e, "CREATE TABLE t (id BIGINT, v BIGINT); CREATE VIEW r AS SELECT id, RANK() OVER (ORDER BY v DESC) AS p FROM t;")
    e.push("t", [(i, i % 7) for i in range(50)])
    e.step()
    assert most_in_one_task(e.snapshot("r")) <= 7
    assert {(r.id, r.p) for r in e.snapshot("r").collect()} == {(i, 1 + sum(j % 7 > i % 7 for j in range(50))) for i in range(50)}
    e.push("t", [(50, 6)])
    e.step()
    assert {(r.id, r.p) for r in e.snapshot("r").collect()} == {(i, 1 + sum((j % 7 if j < 50 else 6) > (i % 7 if i < 50 else 6) for j in range(51))) for i in range(51)}
    now, before = ({(r.id, r.p) for r in e.snapshot("r", t).collect()} for t in (2, 1))
    assert {(r.id, r.p, r["__weight"]) for r in e.delta("r").collect()} == {(*x, 1) for x in now - before} | {(*x, -1) for x in before - now}
