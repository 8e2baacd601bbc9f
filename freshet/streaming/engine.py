"""Incremental views: push signed rows, step, read each view's change or its contents."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking, recursion, zset
from ..sources.tables import shared_dir
from . import maintenance

W = zset.W


class Engine:
    """Tables and SQL views over a Spark session.

    The state is versioned Parquet in the shared folder: one folder a tick and table, and a manifest that is written last,
    so a tick either counts as a whole or not at all. compact() writes a table's sum, from which later ticks go on.

    Rows may be deleted before they are inserted: a row of weight below zero counts as absent until it is made up for, in snapshots and
    changes alike. When the clock has moved between two ticks, the change of a view that looks at it tells of the rows that came
    and went by the clock alone.

    A view's change comes from the tables' changes where the view is linear in each (maintenance.tables_of sees that in its
    plan), from the rows of touched keys where it was declared with keys, and else is the view now less the view before.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, compact_every: int = 0):
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/freshet-engine-{uuid.uuid4().hex}"
        self.schemas: dict[str, str] = {}
        self.lateness: dict[str, tuple[str, int]] = {}
        self.frontier: dict[str, int] = {}
        self.dropped: dict[str, int] = {}
        self.views: dict[str, str] = {}
        self.queued: dict[str, list[DataFrame]] = {}
        self.offsets: dict[str, int] = {}
        self.keys: dict[str, dict[str, list[str]]] = {}
        #: Keys that views' own plans tell.
        self.found: dict[str, dict[str, list[str]]] = {}
        #: Rewrites a view's text once its tables are known (a program sets it).
        self.settle: Callable[[SparkSession, str], str] = lambda spark, sql: sql
        self.append_only: set[str] = set()
        self.bases: list[int] = []
        self.compact_every = compact_every
        #: Tables from which rows were ever deleted: only they may hold rows of weight below zero.
        self.deleted: set[str] = set()
        self.tick, self.clock = 0, 0
        #: The clock at the last tick and at the one before.
        self.clocks = [0, 0]

    def table(self, name: str, schema: str, lateness: tuple[str, int] | None = None, append_only: bool = False) -> None:
        """lateness: (column, how far behind the newest), in microseconds for timestamps and days for dates."""
        self.schemas[name] = schema
        if append_only:
            self.append_only.add(name)
        if lateness:
            self.lateness[name] = lateness

    def view(self, name: str, sql: str, keys: dict[str, list[str]] | None = None) -> None:
        """SQL over tables and earlier views; :now is the engine's clock in microseconds.

        keys: each table's columns by which the view falls apart (of a group, a partition, a join), so that its rows for one
        value follow from the tables' rows of that value alone. Then only touched values are worked out again.
        """
        self.views[name] = sql
        if keys:
            self.keys[name] = keys

    def push(self, name: str, rows: list[tuple] | DataFrame, weight: int = 1) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, self.schemas[name])
        df = zset.weighted(df, weight)
        if name in self.append_only and df.where(F.col(W) < 0).limit(1).count():
            raise ValueError(f"{name} is append-only")
        self.queued.setdefault(name, []).append(df)

    def push_arrow(self, name: str, data: pa.Table | pa.RecordBatch, weights: pa.Array | list[int] | None = None) -> None:
        """Rows as Arrow data, with a weight for each (1 if none are given and the data has no column of them)."""
        table = pa.Table.from_batches([data]) if isinstance(data, pa.RecordBatch) else data
        if weights is not None:
            table = table.append_column(W, pa.array(weights, pa.int64()))
        df = self.spark.createDataFrame(table)
        kinds = self.spark.createDataFrame([], self.schemas[name]).dtypes
        self.push(name, df.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in kinds], *([W] if W in df.columns else [])))

    def delta_arrow(self, view: str) -> pa.Table:
        """The last tick's change as an Arrow table, the weights as its last column. The change must fit the driver; sinks are for larger ones."""
        delta = self.delta(view)
        return delta.select(*[F.col(f"`{c}`") for c in zset.columns(delta)], W).toArrow()

    def register_function(self, name: str, function: Callable | str, returns: str | None = None) -> None:
        """A function that views may call: SQL ("(x INT) RETURNS INT RETURN x + 1"), or Python over pandas series with its type, or for aggregates one made by pandas_udf."""
        if isinstance(function, str):
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{function}")
        else:
            self.spark.udf.register(name, F.pandas_udf(function, returns) if returns else function)

    def last_tick(self) -> int:
        """The last tick that the state's folder holds whole, 0 if there is none."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        folders = [x.getPath() for x in fs.listStatus(p)] if fs.exists(p) else []
        whole = [f.getName() for f in folders if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
        return max((int(n[5:]) for n in whole if n.startswith("tick=")), default=0)

    def advance_clock(self, micros: int) -> None:
        if micros < self.clock:
            raise ValueError("the clock only moves on")
        self.clock = micros

    def _empty(self, name: str) -> DataFrame:
        return zset.weighted(self.spark.createDataFrame([], self.schemas[name]))

    def _path(self, name: str, tick: int) -> str:
        return f"{self.root}/{name}/tick={tick}"

    def integral(self, name: str, tick: int) -> DataFrame:
        if tick == 0:
            return self._empty(name)
        base = max((b for b in self.bases if b <= tick), default=0)
        paths = [f"{self.root}/{name}/base={base}"] if base else []
        paths += [self._path(name, t) for t in range(base + 1, tick + 1)]
        return zset.normalise(self.spark.read.schema(self._empty(name).schema).parquet(*paths))

    def change(self, name: str) -> DataFrame:
        """The table's own change in the last tick, as far as it shows: rows of weight below zero don't."""
        if not self.tick:
            return self._empty(name)
        raw = self.spark.read.schema(self._empty(name).schema).parquet(self._path(name, self.tick))
        if name not in self.deleted:
            return raw
        keys = zset.columns(raw)
        same = [F.col(f"o.`{k}`").eqNullSafe(F.col(f"t.`{k}`")) for k in keys]
        old = raw.alias("t").join(self.integral(name, self.tick - 1).alias("o"), same, "left").select(*[F.col(f"t.`{k}`") for k in keys], F.col(f"t.{W}").alias("__d"), F.coalesce(F.col(f"o.{W}"), F.lit(0)).alias("__o"))
        shown = F.greatest(F.lit(0), F.col("__o") + F.col("__d")) - F.greatest(F.lit(0), F.col("__o"))
        return old.select(*[F.col(f"`{k}`") for k in keys], shown.cast("bigint").alias(W)).where(F.col(W) != 0)

    def compact(self) -> None:
        """Writes each table's sum; the next tick's manifest makes it count. Till then, and for older ticks, the ticks are read."""
        for name in self.schemas:
            self.integral(name, self.tick).write.mode("overwrite").parquet(f"{self.root}/{name}/base={self.tick}")
        self.bases = [b for b in self.bases if b != self.tick] + [self.tick]

    def vacuum(self) -> None:
        """Removes the ticks that went into a sum that a later manifest names: recover() and snapshots reach back to it."""
        last = max((b for b in self.bases if b < self.tick), default=0)
        gone = [f"tick={t}" for t in range(1, last + 1)] + [f"base={b}" for b in self.bases if b < last]
        for name in self.schemas:
            for g in gone:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{g}")
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.bases = [b for b in self.bases if b >= last]

    def _on_time(self, name: str, delta: DataFrame) -> DataFrame:
        if name not in self.lateness:
            return delta
        column, late_by = self.lateness[name]
        limit = self.frontier.get(name)
        kind, at = dict(delta.dtypes)[column], F.col(f"`{column}`")
        at = F.unix_micros(at.cast("timestamp")) if kind.startswith("timestamp") else F.unix_date(at) if kind == "date" else at
        late = F.lit(False) if limit is None else F.coalesce(at < limit, F.lit(True))
        n, top = delta.agg(F.count_if(late), F.max(at)).first()
        self.dropped[name] = self.dropped.get(name, 0) + n
        if top is not None:
            self.frontier[name] = max(limit if limit is not None else top - late_by, top - late_by)
        return delta if limit is None else delta.where(at >= limit)

    def step(self) -> int:
        """Commits what was pushed as the next tick; late rows are those below the frontier that the tick found."""
        t = self.tick + 1
        for name in self.schemas:
            delta = self._empty(name)
            for part in self.queued.pop(name, []):
                delta = delta.unionByName(part)
            seen = Observation()
            rows = zset.normalise(self._on_time(name, delta))
            rows.observe(seen, F.count_if(F.col(W) < 0).alias("gone")).write.mode("overwrite").parquet(self._path(name, t))
            if seen.get["gone"]:
                self.deleted.add(name)
        self.tick, self.clocks = t, [self.clock, self.clocks[0]]
        state = {"tick": t, "clock": self.clock, "clocks": self.clocks, "deleted": sorted(self.deleted), "frontier": self.frontier, "dropped": self.dropped, "offsets": self.offsets, "bases": self.bases, "schemas": self.schemas, "views": self.views}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/manifest/tick={t}")
        if self.compact_every and t % self.compact_every == 0:
            self.compact()
        return t

    def recover(self, tick: int) -> None:
        """Goes on from a committed tick, as another process left it."""
        state = json.loads(self.spark.read.text(f"{self.root}/manifest/tick={tick}").first()[0])
        for what, mine in (("schemas", self.schemas), ("views", self.views)):
            changed = [k for k in mine if state.get(what, {}).get(k, mine[k]) != mine[k]]
            if changed:
                raise ValueError(f"the state was made with other {what}: {', '.join(sorted(changed))}")
        self.offsets, self.bases = state.get("offsets", {}), state.get("bases", [])
        self.clocks, self.deleted = state.get("clocks", [state["clock"]] * 2), set(state.get("deleted", self.schemas))
        self.tick, self.clock, self.frontier, self.dropped = state["tick"], state["clock"], state["frontier"], state["dropped"]

    def _view(self, view: str, frames: dict[str, DataFrame], clock: int) -> DataFrame:
        """The view's rows over these bags."""
        for name, df in frames.items():
            df.createOrReplaceTempView(name)
        for name, sql in self.views.items():
            recursion.run(self.spark, sql.replace(":now", str(clock)), self.settle).createOrReplaceTempView(name)
            if name == view:
                return self.spark.table(name)
        raise KeyError(view)

    def snapshot(self, view: str, tick: int | None = None, clock: int | None = None) -> DataFrame:
        """The view's rows as a bag."""
        t = self.tick if tick is None else tick
        frames = {name: zset.expand(self.integral(name, t)) for name in self.schemas}
        return ranking.spread(self._view(view, frames, self.clock if clock is None else clock))

    def _texts(self, view: str) -> str:
        """The texts of the view and of all that were declared before it, which it may read."""
        names = list(self.views)
        return "\n".join(self.views[n] for n in names[: names.index(view) + 1])

    def rule(self, view: str) -> tuple[str, list[str]]:
        """How the view's change is found ("linear", "keyed" or "whole"), and the tables that it goes by."""
        if view not in self.keys and re.search(r"\bRECURSIVE\b", self._texts(view), re.I):
            return "whole", list(self.schemas)
        empty = {name: self.spark.createDataFrame([], schema) for name, schema in self.schemas.items()}
        df = self._view(view, empty, self.clock)
        used = maintenance.tables_of(df, set(self.schemas))
        if used:
            return "linear", sorted(used)
        if view not in self.keys and (found := maintenance.keys_of(df, set(self.schemas))):
            self.found[view] = found
        keys = self.keys.get(view) or self.found.get(view)
        return ("keyed", list(keys)) if keys else ("whole", list(self.schemas))

    def delta(self, view: str, clock_before: int | None = None) -> DataFrame:
        """The signed change of the last tick; clock_before is the clock at the tick before, unless given."""
        before, now = self.clocks[1] if clock_before is None else clock_before, self.clocks[0]
        moved = before != now and ":now" in self._texts(view)
        rule, used = ("whole", []) if moved else self.rule(view)
        old, new = (lambda n: zset.positive(self.integral(n, self.tick - 1))), (lambda n: zset.positive(self.integral(n, self.tick)))
        if rule == "linear":
            rest = {n: self.spark.createDataFrame([], self.schemas[n]) for n in self.schemas if n not in used}
            return maintenance.linear_delta(used, old, self.change, new, lambda frames: self._view(view, rest | frames, now))
        if rule == "keyed" and not any(self.change(n).limit(1).count() for n in self.schemas if n not in used):
            rest = {n: zset.expand(new(n)) for n in self.schemas if n not in used}
            return maintenance.keyed_delta(self.keys.get(view) or self.found[view], old, self.change, new, lambda frames: self._view(view, rest | frames, now))
        return zset.minus(zset.weighted(self.snapshot(view, self.tick, now)), zset.weighted(self.snapshot(view, self.tick - 1, before)))

    def stats(self) -> DataFrame:
        """For each table: rows retained, rows of the last tick, frontier and late rows dropped. Counted from the state's files."""
        rows = []
        for name in self.schemas:
            last = self.spark.read.schema(self._empty(name).schema).parquet(self._path(name, self.tick)).count() if self.tick else 0
            rows.append((name, self.integral(name, self.tick).count(), last, self.frontier.get(name), self.dropped.get(name, 0)))
        return self.spark.createDataFrame(rows, "name string, retained bigint, last bigint, frontier bigint, dropped bigint")
