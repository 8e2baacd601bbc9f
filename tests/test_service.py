"""Pipelines as they are deployed, paused, gone on with and deployed again; Arrow data; functions of the user's own."""

import pyarrow as pa
import pytest

from freshet.operators import zset
from freshet.streaming.engine import Engine
from freshet.streaming.runner import Sink, VersionedSource
from freshet.streaming.service import Pipeline

TEXT = "CREATE TABLE sales (cat VARCHAR(8), amt BIGINT); CREATE VIEW totals AS SELECT cat, SUM(amt) AS total FROM sales GROUP BY cat;"


def put(spark, path, version, rows):
    spark.createDataFrame(rows, "cat string, amt long").coalesce(1).write.parquet(f"{path}/v={version}")


def test_pipeline(spark, tmp_path):
    source, root = f"{tmp_path}/sales", f"{tmp_path}/state"
    put(spark, source, 0, [("a", 1), ("b", 2)])
    made = lambda: Pipeline(spark, TEXT, {"sales": VersionedSource(source)}, [Sink("totals", f"{tmp_path}/out", "truncate")], root)
    p = made().deploy()
    assert p.wait(120) and p.stats()["tick"] == 1
    p.pause()
    put(spark, source, 1, [("a", 5)])
    assert p.stats()["status"] == "paused" and p.stats()["offsets"] == {"sales": 0}
    with pytest.raises(RuntimeError):
        p.wait(1)
    p.resume()
    while p.stats()["offsets"]["sales"] < 1:
        p.wait(120)
    p.pause()
    assert sorted(map(tuple, p.view("totals").collect())) == [("a", 6), ("b", 2)]
    p.stop()
    put(spark, source, 2, [("c", 9)])
    p = made().deploy()
    while p.stats()["offsets"].get("sales", -1) < 2:
        p.wait(120)
    p.pause()
    assert p.stats()["tick"] == 3 and sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [("a", 6), ("b", 2), ("c", 9)]
    p.stop()
    assert p.stats()["status"] == "stopped"


def test_failure_is_told(spark, tmp_path):
    source = f"{tmp_path}/sales"
    spark.createDataFrame([("x",)], "other string").write.parquet(f"{source}/v=0")
    p = Pipeline(spark, TEXT, {"sales": VersionedSource(source)}, [], f"{tmp_path}/state").deploy()
    with pytest.raises(RuntimeError):
        p.wait(120)
    assert p.stats()["status"] == "failed" and p.stats()["error"]


def test_arrow_and_functions(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/s")
    e.table("t", "k int, v double")
    e.register_function("twice", "(x DOUBLE) RETURNS DOUBLE RETURN x * 2")
    e.register_function("plus_one", lambda s: s + 1, "double")
    e.view("w", "SELECT k, plus_one(twice(v)) AS w FROM t")
    e.push_arrow("t", pa.record_batch({"k": [1, 2, 3], "v": [0.5, 1.5, None]}), [1, 2, 1])
    e.step()
    got = e.delta_arrow("w")
    assert got.column_names == ["k", "w", zset.W]
    assert sorted(map(tuple, (r.values() for r in got.to_pylist())), key=str) == [(1, 2.0, 1), (2, 4.0, 2), (3, None, 1)]
    e.push_arrow("t", pa.table({"k": [2], "v": [1.5]}), [-1])
    e.step()
    assert e.delta_arrow("w").to_pylist() == [{"k": 2, "w": 4.0, zset.W: -1}]
