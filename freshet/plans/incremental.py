"""Views kept by the incremental engine over three ticks of the events table: all inserted, clicks deleted, clicks inserted again.

Each query adds up the view's signed changes of every tick, so it equals the view's SQL on the whole table only if each
change is the derivative of the view.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import zset
from ..streaming.engine import Engine

VIEWS = {
    "ivm_join_aggregate": "SELECT n.n_name, e.event_type, count(*) AS n FROM events e JOIN nation n ON e.user_id % 25 = n.n_nationkey GROUP BY n.n_name, e.event_type",
    "ivm_distinct": "SELECT DISTINCT user_id, event_type FROM events",
    "ivm_top_k": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) t WHERE r <= 3",
    "ivm_outer_join": "SELECT n.n_name, e.event_id FROM nation n LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') e ON e.user_id = n.n_nationkey",
}
VIEWS["ivm_semi_join"] = "SELECT n_name FROM nation n WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = n.n_nationkey AND e.event_type = 'click')"
VIEWS["ivm_linear_join"] = "SELECT n.n_name, e.event_id, e.value FROM events e JOIN nation n ON e.user_id = n.n_nationkey WHERE e.value > 20"
#: Rows this many microseconds (ten days) behind the newest are late.
LATE = 864_000_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in df.dtypes)


def maintained(name_of_view: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    events, nation = _events(spark, sf_dir), spark.read.parquet(f"{sf_dir}/nation.parquet")
    clicks = events.where("event_type = 'click'")
    engine = Engine(spark)
    for name, df in (("events", events), ("nation", nation)):
        engine.table(name, _ddl(df))
    engine.view("v", VIEWS[name_of_view])
    changes = []
    for ticks in ([("events", events, 1), ("nation", nation, 1)], [("events", clicks, -1)], [("events", clicks, 1)]):
        for name, rows, weight in ticks:
            engine.push(name, rows, weight)
        engine.step()
        changes.append(engine.delta("v"))
    total = changes[0]
    for more in changes[1:]:
        total = zset.plus(total, more)
    return zset.expand(total)


def on_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views arrive first, all else after: what lies below the frontier that the views set is dropped."""
    events = _events(spark, sf_dir).select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    engine = Engine(spark)
    engine.table("events", _ddl(events), lateness=("us", LATE))
    engine.view("v", "SELECT event_id, event_type FROM events")
    for rows in (events.where("event_type = 'view'"), events.where("event_type <> 'view'")):
        engine.push("events", rows)
        engine.step()
    return engine.snapshot("v")


def _summed(engine: Engine, steps: list) -> DataFrame:
    """The view v's changes over the steps' ticks, added up."""
    total = None
    for step in steps:
        step()
        engine.step()
        total = engine.delta("v") if total is None else zset.plus(total, engine.delta("v"))
    return zset.expand(total)


#: The last week before this instant (2024-01-15, in microseconds) is what the temporal filter shows in the end.
NOW, WEEK = 1_705_276_800_000_000, 604_800_000_000


def temporal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on the clock, which moves on between ticks without any new rows: events come into the week and leave it."""
    events = _events(spark, sf_dir).select("event_id", "ts")
    engine = Engine(spark)
    engine.table("events", _ddl(events))
    engine.view("v", f"SELECT event_id FROM events WHERE unix_micros(CAST(ts AS TIMESTAMP)) > :now - {WEEK} AND unix_micros(CAST(ts AS TIMESTAMP)) <= :now")
    return _summed(engine, [lambda: (engine.push("events", events), engine.advance_clock(NOW - 2 * WEEK)), lambda: engine.advance_clock(NOW - WEEK // 2), lambda: engine.advance_clock(NOW)])


def deleted_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are deleted before all events are inserted: what was owed is made up for."""
    events = _events(spark, sf_dir).select("event_id", "event_type")
    engine = Engine(spark)
    engine.table("events", _ddl(events))
    engine.view("v", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
    return _summed(engine, [lambda: engine.push("events", events.where("event_type = 'click'"), -1), lambda: engine.push("events", events)])


QUERIES = {k: partial(maintained, k) for k in VIEWS} | {"ivm_lateness": on_time, "ivm_temporal_filter": temporal_filter, "ivm_negative_weight": deleted_first}
ORACLE_SQL = VIEWS | {
    "ivm_temporal_filter": f"SELECT event_id FROM events WHERE epoch_us(ts) > {NOW - WEEK} AND epoch_us(ts) <= {NOW}",
    "ivm_negative_weight": "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY event_type",
    "ivm_lateness": f"SELECT event_id, event_type FROM events WHERE event_type = 'view' OR epoch_us(ts) >= (SELECT max(epoch_us(ts)) - {LATE} FROM events WHERE event_type = 'view')",
}
