import pytest

from freshet.operators import zset
from freshet.sources.tables import from_ipc, to_ipc
from freshet.streaming.engine import Engine
from freshet.streaming.runner import Sink, VersionedSource, follow, resume, run

W = zset.W


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_delta_is_derivative_and_state_recovers(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.table("t", "k int, v int")
    e.view("s", "SELECT k, count(*) AS n, sum(v) AS total FROM t GROUP BY k")
    e.push("t", [(1, 5), (1, 6), (2, None)])
    e.step()
    assert bag(e.delta("s")) == [(1, 2, 11, 1), (2, 1, None, 1)]
    e.push("t", [(1, 5)], -1)
    e.step()
    assert bag(e.delta("s")) == [(1, 1, 6, 1), (1, 2, 11, -1)]
    e.step()
    assert bag(e.delta("s")) == []
    other = Engine(spark, f"file://{tmp_path}")
    other.table("t", "k int, v int")
    other.view("s", e.views["s"])
    other.recover(2)
    assert bag(other.snapshot("s")) == [(1, 1, 6), (2, 1, None)]


def test_lateness_drops_below_the_frontier(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.table("t", "ts bigint, v int", lateness=("ts", 10))
    e.view("a", "SELECT * FROM t")
    e.push("t", [(100, 1)])
    e.step()
    e.push("t", [(89, 2), (90, 3)])
    e.step()
    assert set(bag(e.snapshot("a"))) == {(90, 3), (100, 1)} and e.dropped["t"] == 1


def test_rules_agree_with_the_definition(spark):
    make = lambda rows: spark.createDataFrame(rows, f"k int, v int, {W} bigint")
    old, d = make([(1, 1, 1), (1, 2, 2), (None, 3, 1)]), make([(1, 1, -1), (2, 5, 1), (None, 3, 1)])
    assert bag(zset.distinct_delta(old, d)) == bag(zset.minus(zset.distinct(zset.plus(old, d)), zset.distinct(old)))
    b, db = make([(1, 7, 1)]).withColumnRenamed("v", "x"), make([(2, 8, 1)]).withColumnRenamed("v", "x")
    want = zset.minus(zset.join(zset.plus(old, d), zset.plus(b, db), ["k"]), zset.join(old, b, ["k"]))
    assert bag(zset.join_delta(old, d, zset.plus(b, db), db, ["k"])) == bag(want)
    assert bag(zset.sums_delta(old, d, ["k"], "v")) == [(1, 2, 4, 1), (1, 3, 5, -1), (2, 1, 5, 1), (None, 1, 3, -1), (None, 2, 6, 1)]
    assert bag(from_ipc(spark, to_ipc(d))) == bag(d)


def program(spark, root):
    e = Engine(spark, f"file://{root}/state")
    e.table("t", "k int, v int")
    e.table("u", "k int, name string")
    e.view("j", "SELECT u.name, t.v FROM t JOIN u ON t.k = u.k")
    e.view("s", "SELECT name, sum(v) AS total FROM j GROUP BY name")
    return e


def test_runner_counts_each_version_once(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, 6)], "k int, v int").write.parquet(f"{tmp_path}/t/v=0")
    spark.createDataFrame([(1, 5, "update_preimage"), (1, 9, "update_postimage"), (2, 6, "delete")], "k int, v int, _change_type string").write.parquet(f"{tmp_path}/t/v=1")
    spark.sql("SELECT named_struct('id', 1, 'label', named_struct('text', 'a')) AS r").write.parquet(f"{tmp_path}/u/v=0")
    sources = {"t": VersionedSource(f"file://{tmp_path}/t"), "u": VersionedSource(f"file://{tmp_path}/u", {"k": "r.id", "name": "r.label.text"})}
    sinks = [Sink("s", f"file://{tmp_path}/s"), Sink("j", f"file://{tmp_path}/j", "truncate")]
    e = program(spark, tmp_path)
    assert run(e, sources, sinks) == 3 and run(e, sources, sinks) == 0
    log = spark.read.parquet(f"file://{tmp_path}/s").groupBy("name", "total").agg({W: "sum"}).where(f"sum({W}) <> 0")
    assert bag(log) == [("a", 9, 1)] and bag(spark.read.parquet(f"file://{tmp_path}/j")) == [("a", 9)]
    again = program(spark, tmp_path)
    assert resume(again, 2, sources, sinks) == 1 and bag(again.snapshot("s")) == [("a", 9)]
    assert {r.name: (r.retained, r.last) for r in again.stats().collect()} == {"t": (1, 3), "u": (1, 0)}
    other = program(spark, tmp_path)
    other.view("s", "SELECT name, count(*) AS total FROM j GROUP BY name")
    with pytest.raises(ValueError, match="other views: s"):
        other.recover(3)


def test_stream_feeds_ticks(spark, tmp_path):
    for part in ([(1, 5)], [(1, 6), (3, 7)]):
        spark.createDataFrame(part, "k int, v int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    e = program(spark, tmp_path)
    e.push("u", [(1, "a")])
    e.step()
    stream = spark.readStream.schema("k int, v int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    follow(e, "t", stream, [], f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert e.tick == 3 and bag(e.snapshot("s")) == [("a", 11)]


RULES = {
    "linear_join": ("SELECT e.id, n.name FROM ev e JOIN na n ON e.k = n.k WHERE e.id > 1", None, "linear"),
    "linear_flat": ("SELECT id, explode(array(k, id)) AS x FROM ev", None, "linear"),
    "keyed_sum": ("SELECT k, count(*) AS n, sum(id) AS s FROM ev GROUP BY k", {"ev": ["k"]}, "keyed"),
    "keyed_outer": ("SELECT n.name, e.id FROM na n LEFT JOIN ev e ON e.k = n.k", {"ev": ["k"], "na": ["k"]}, "keyed"),
    "found_distinct": ("SELECT DISTINCT k FROM ev", None, "keyed"),
    "found_sum": ("SELECT n.name, count(*) AS c FROM ev e JOIN na n ON e.k = n.k GROUP BY n.name", None, "keyed"),
    "found_outer": ("SELECT n.name, x.c FROM na n LEFT JOIN (SELECT k, count(*) AS c FROM ev GROUP BY k) x ON x.k = n.k", None, "keyed"),
    "found_anti": ("SELECT n.name FROM na n WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.k = n.k)", None, "whole"),
    "found_window": ("SELECT * FROM (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY id) AS r FROM ev) t WHERE r = 1", None, "keyed"),
    "nullable_side": ("SELECT x.k, count(*) AS c FROM na n LEFT JOIN ev x ON x.k = n.k GROUP BY x.k", None, "whole"),
    "whole": ("SELECT count(*) AS c FROM ev", None, "whole"),
}


@pytest.mark.parametrize("name", sorted(RULES))
def test_rules_give_the_whole_difference(spark, tmp_path, name):
    sql, keys, rule = RULES[name]
    e = Engine(spark, str(tmp_path / "s"), compact_every=2)
    e.table("ev", "id int, k int")
    e.table("na", "k int, name string")
    e.view("v", sql, keys)
    assert e.rule("v")[0] == rule
    ticks = [
        [("ev", [(1, 1), (2, 1), (2, 1), (3, None)], 1), ("na", [(1, "a"), (2, "b"), (None, "z")], 1)],
        [("ev", [(2, 1)], -1), ("ev", [(4, 2)], 1)],
        [("na", [(1, "a")], -1), ("na", [(1, "c")], 1), ("ev", [(5, 1), (6, None)], 1)],
        [],
        [("ev", [(2, 1), (4, 2)], -1)],
    ]
    for tick in ticks:
        for table, rows, weight in tick:
            e.push(table, rows, weight)
        e.step()
        want = zset.minus(zset.weighted(e.snapshot("v")), zset.weighted(e.snapshot("v", e.tick - 1)))
        assert sorted(map(repr, e.delta("v").select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    before = sorted(map(repr, e.snapshot("v").collect()))
    e.vacuum()
    again = Engine(spark, e.root)
    again.table("ev", "id int, k int")
    again.table("na", "k int, name string")
    again.view("v", sql, keys)
    again.recover(5)
    assert sorted(map(repr, e.snapshot("v").collect())) == before == sorted(map(repr, again.snapshot("v").collect()))


def test_append_only(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.table("t", "a int", append_only=True)
    with pytest.raises(ValueError):
        e.push("t", [(1,)], -1)


def added_up(engine, view, deltas):
    total = counted(engine.snapshot(view, 0))  # a count of nothing is a row
    for r in deltas:
        total[tuple(r)[:-1]] = total.get(tuple(r)[:-1], 0) + r[zset.W]
    return {k: v for k, v in total.items() if v}


def counted(df):
    out = {}
    for r in df.collect():
        out[tuple(r)] = out.get(tuple(r), 0) + 1
    return out


def test_clock_alone_moves_rows(spark, tmp_path):
    """Rows that come and go by the clock are in the change of the tick that moved it, in a sink, and after a restart."""
    e = Engine(spark, str(tmp_path / "s"))
    e.table("t", "at bigint, v int")
    e.view("recent", "SELECT v FROM t WHERE at > :now - 10 AND at <= :now")
    e.view("all_rows", "SELECT v FROM t")
    sink = Sink("recent", str(tmp_path / "log"))
    e.push("t", [(1, 1), (5, 2), (12, 3)])
    for clock in (5, 11, 15, 15, 40):
        e.advance_clock(clock)
        e.step()
        sink.write(e)
    assert e.delta("all_rows").count() == 0
    log = [spark.read.parquet(f"{tmp_path}/log/tick={t}").collect() for t in range(1, 6)]
    assert [sorted((r.v, r[zset.W]) for r in x) for x in log] == [[(1, 1), (2, 1)], [(1, -1)], [(2, -1), (3, 1)], [], [(3, -1)]]
    again = Engine(spark, e.root)
    again.table("t", "at bigint, v int")
    again.view("recent", "SELECT v FROM t WHERE at > :now - 10 AND at <= :now")
    again.recover(3)
    assert sorted((r.v, r[zset.W]) for r in again.delta("recent").collect()) == [(2, -1), (3, 1)]


def test_deletion_before_insertion(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.table("t", "k int, v int")
    e.table("u", "k int, w int")
    views = {"same": "SELECT * FROM t", "sums": "SELECT k, count(*) AS n FROM t GROUP BY k", "both": "SELECT t.v, u.w FROM t JOIN u ON t.k = u.k"}
    for name, sql in views.items():
        e.view(name, sql)
    deltas = {name: [] for name in views}
    for tick in ([("t", [(1, 1)], -1), ("u", [(1, 7)], 1)], [("t", [(1, 1), (1, 1), (1, 2)], 1)], [("u", [(1, 7), (1, 7)], -1)], [("u", [(1, 7)], 1), ("t", [(1, 2)], -1)], [("u", [(1, 7)], 1)]):
        for table, rows, weight in tick:
            e.push(table, rows, weight)
        e.step()
        for name in views:
            deltas[name] += e.delta(name).collect()
            assert added_up(e, name, deltas[name]) == counted(e.snapshot(name)), (name, e.tick)
    assert counted(e.snapshot("same")) == {(1, 1): 1} and counted(e.snapshot("both")) == {(1, 7): 1}


def random_view(draw):
    """A random query over t(k, v), u(k, v) and n(k, v) with NULLs: a source, a filter, and one of the operators on top."""
    a, b = draw.sample(["t", "u", "n"], 2)
    where = draw.choice(["", f" WHERE {a}.v > {draw.randint(0, 4)}", f" WHERE {a}.k IS DISTINCT FROM {draw.randint(0, 5)}"])
    return draw.choice(
        [
            f"SELECT {a}.k, {a}.v + 1 AS w FROM {a}{where}",
            f"SELECT {a}.v, {b}.v AS w FROM {a} JOIN {b} ON {a}.k = {b}.k{where}",
            f"SELECT {a}.v, {b}.v AS w FROM {a} {draw.choice(['LEFT', 'FULL', 'RIGHT'])} JOIN {b} ON {a}.k = {b}.k",
            f"SELECT {a}.k, count(*) AS c, sum({a}.v) AS s, max({a}.v) AS m FROM {a}{where} GROUP BY {a}.k",
            f"SELECT {b}.k, count({a}.v) AS c FROM {a} JOIN {b} ON {a}.k = {b}.k{where} GROUP BY {b}.k HAVING count(*) > 1",
            f"SELECT DISTINCT {a}.v FROM {a}{where}",
            f"SELECT {a}.k FROM {a}{where} UNION SELECT v FROM {b}",
            f"SELECT k FROM {a} EXCEPT SELECT k FROM {b}",
            f"SELECT {a}.v FROM {a} WHERE {draw.choice(['', 'NOT '])}EXISTS (SELECT 1 FROM {b} WHERE {b}.k = {a}.k)",
            f"SELECT k, v, r FROM (SELECT k, v, rank() OVER (PARTITION BY k ORDER BY v DESC) AS r FROM {a}) x WHERE r <= 2",
            f"SELECT count(*) AS c, min(v) AS m FROM {a}{where}",
        ]
    )


@pytest.mark.parametrize("seed", range(4))
def test_random_views_add_up(spark, tmp_path, seed):
    """The changes of random views over random ticks, deletions before insertions included, add up to the views."""
    import random

    draw = random.Random(seed)
    e = Engine(spark, str(tmp_path / "s"), compact_every=2)
    for name in ("t", "u", "n"):
        e.table(name, "k int, v int")
    views = {f"v{i}": random_view(draw) for i in range(5)}
    for name, sql in views.items():
        e.view(name, sql)
    deltas = {name: [] for name in views}
    value = lambda table: None if table == "n" and draw.random() < 0.25 else draw.randint(0, 5)
    for _ in range(3):
        for _ in range(draw.randint(0, 6)):
            table = draw.choice(["t", "u", "n"])
            e.push(table, [(value(table), value(table)) for _ in range(draw.randint(1, 3))], draw.choice([1, 1, -1]))
        e.step()
        for name, sql in views.items():
            deltas[name] += e.delta(name).collect()
            assert added_up(e, name, deltas[name]) == counted(e.snapshot(name)), (sql, e.tick, e.rule(name))


def test_recursive_view(spark, tmp_path):
    """Reach over edges that come and go, a cycle among them."""
    from freshet.plans import program

    e = Engine(spark, str(tmp_path / "s"))
    program.load(e, "CREATE TABLE edges (src INT, dst INT); CREATE VIEW reach AS WITH RECURSIVE r AS (SELECT src, dst FROM edges UNION ALL SELECT x.src, y.dst FROM r x JOIN edges y ON x.dst = y.src) SELECT src, dst FROM r")
    have, deltas = set(), []
    for add, drop in (({(1, 2), (2, 3), (3, 1), (4, 5)}, set()), ({(3, 4)}, {(1, 2)}), (set(), {(2, 3), (3, 1)})):
        e.push("edges", sorted(add)) if add else None
        e.push("edges", sorted(drop), -1) if drop else None
        e.step()
        have = have | add - drop
        have -= drop
        reach = set(have)
        while more := {(a, d) for a, b in reach for c, d in have if b == c} - reach:
            reach |= more
        deltas += e.delta("reach").collect()
        assert added_up(e, "reach", deltas) == counted(e.snapshot("reach")) == dict.fromkeys(reach, 1)


def test_fixpoints(spark):
    """Naive rounds, semi-naive rounds and doubling agree; NULLs equal one another, an empty start gives nothing."""
    from pyspark.sql import functions as F

    from freshet.operators import recursion

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2), (5, None), (None, 5)], "src int, dst int")
    one = lambda new: new.alias("a").join(edges.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src"), F.col("b.dst"))
    got = [sorted(map(tuple, r.collect()), key=repr) for r in (recursion.naive(edges, one), recursion.fixpoint(edges, lambda new, every: one(new)), recursion.closure(edges))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 15
    assert recursion.closure(edges.limit(0)).count() == 0
