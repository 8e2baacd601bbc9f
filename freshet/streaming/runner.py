"""Programs of many sources and views: one tick for each source version, offsets committed with the tick, sinks fed after it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources import tables
from .engine import Engine


@dataclass(frozen=True)
class VersionedSource:
    """A folder of changes, one subfolder v=N a version. fields maps a table's column to a (dotted) path in the files."""

    path: str
    fields: dict[str, str] | None = None

    def latest_offset(self, spark: SparkSession) -> int:
        """The last version, -1 if there is none. Asked of the file system that the path names."""
        p = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()), default=-1)

    def next(self, spark: SparkSession, offset: int) -> DataFrame:
        df = tables.read_version(spark, self.path, offset)
        return df.selectExpr(*[f"{p} AS `{c}`" for c, p in self.fields.items()], tables.W) if self.fields else df


@dataclass(frozen=True)
class Sink:
    """Where a view goes: truncate writes it whole after each tick, changelog adds the tick's signed rows."""

    view: str
    path: str
    mode: str = "changelog"

    def write(self, engine: Engine, clock_before: int | None = None) -> None:
        if self.mode == "truncate":
            tables.write_truncate(engine.snapshot(self.view), self.path)
        else:
            tables.write_changelog(engine.delta(self.view, clock_before), self.path, engine.tick)


def run(engine: Engine, sources: dict[str, VersionedSource], sinks: list[Sink], until: Callable[[], bool] = lambda: False) -> int:
    """Takes what the sources hold, in turns, till all are drained or until says so; returns the ticks made.

    A tick's offsets are in its manifest, so after recover() each version counts exactly once. Sinks write what follows from
    committed state and overwrite by tick: a run that broke off between commit and sink is put right by resume().
    """
    made = 0
    while not until():
        moved = False
        for name, source in sources.items():
            at = engine.offsets.get(name, -1) + 1
            if at > source.latest_offset(engine.spark):
                continue
            engine.push(name, source.next(engine.spark, at))
            engine.offsets[name] = at
            engine.step()
            for sink in sinks:
                sink.write(engine)
            made, moved = made + 1, True
        if not moved:
            break
    return made


def resume(engine: Engine, tick: int, sources: dict[str, VersionedSource], sinks: list[Sink]) -> int:
    """Goes on from a committed tick: its sinks are written again, then run()."""
    engine.recover(tick)
    for sink in sinks if tick else []:
        sink.write(engine)
    return run(engine, sources, sinks)


def follow(engine: Engine, name: str, stream: DataFrame, sinks: list[Sink], checkpoint: str):
    """A streaming DataFrame as a source: each micro-batch is a tick. Batches that the engine has committed are not taken twice."""

    def take(batch: DataFrame, number: int) -> None:
        if number > engine.offsets.get(name, -1):
            engine.push(name, batch)
            engine.offsets[name] = number
            engine.step()
        for sink in sinks:
            sink.write(engine)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
