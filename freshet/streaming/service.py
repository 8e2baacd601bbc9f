"""A program as a running pipeline: deployed, paused, gone on with, waited for and asked how it does, from Python."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..plans import program
from .engine import Engine
from .runner import Sink, VersionedSource, run


@dataclass
class Pipeline:
    """One thread that takes what the sources hold, tick by tick, while it is running.

    Its state is the engine's folder: a pipeline deployed again over the same folder goes on after the last committed tick,
    and each source version counts once. A failure stops it, is kept in error, and is raised by wait().
    """

    spark: SparkSession
    text: str
    sources: dict[str, VersionedSource]
    sinks: list[Sink]
    root: str
    #: Seconds between two looks at sources that held nothing new.
    every: float = 0.2
    compact_every: int = 0
    engine: Engine = field(init=False)
    status: str = field(default="new", init=False)
    error: BaseException | None = field(default=None, init=False)
    made: int = field(default=0, init=False)

    def deploy(self) -> Pipeline:
        """Reads the program, recovers the last committed tick (its sinks are written again) and starts."""
        if self.status in ("running", "paused"):
            raise RuntimeError("the pipeline is already deployed")
        self.engine = Engine(self.spark, self.root, self.compact_every)
        program.load(self.engine, self.text)
        last = self.engine.last_tick()
        if last:
            self.engine.recover(last)
            for sink in self.sinks:
                sink.write(self.engine)
        self._go, self._stop, self._idle = threading.Event(), threading.Event(), threading.Event()
        self._go.set()
        self.status, self.error = "running", None
        self._thread = threading.Thread(target=self._work, daemon=True)
        self._thread.start()
        return self

    def _work(self) -> None:
        try:
            while not self._stop.is_set():
                self._go.wait()
                if self._stop.is_set():
                    break
                self._idle.clear()
                made = run(self.engine, self.sources, self.sinks, until=lambda: self._stop.is_set() or not self._go.is_set())
                self.made += made
                if self._go.is_set() and not made:
                    self._idle.set()
                    time.sleep(self.every)
                elif not self._go.is_set():
                    self._idle.set()
        except BaseException as e:  # told by wait()
            self.status, self.error = "failed", e
            self._idle.set()

    def pause(self) -> None:
        """Stops taking input after the tick at hand; returns when that is committed."""
        self._go.clear()
        self.status = "paused" if self.status == "running" else self.status
        self._idle.wait()

    def resume(self) -> None:
        if self.status == "paused":
            self.status = "running"
            self._idle.clear()
            self._go.set()

    def wait(self, timeout: float | None = None) -> bool:
        """Till all sources are drained (True), or for timeout seconds at most (False then)."""
        if self.status == "paused":
            raise RuntimeError("the pipeline is paused")
        done = self._idle.wait(timeout)
        if self.error is not None:
            raise RuntimeError("the pipeline has failed") from self.error
        return done

    def stop(self) -> None:
        """Ends the thread after the tick at hand. The state stays: deploy() goes on from it."""
        self._stop.set()
        self._go.set()
        self._thread.join()
        self.status = self.status if self.status == "failed" else "stopped"

    def stats(self) -> dict:
        """Status, ticks, offsets, clock, frontiers and late rows; the tables' rows come from Engine.stats()."""
        e = self.engine
        return {"status": self.status, "tick": e.tick, "ticks_made": self.made, "offsets": dict(e.offsets), "clock": e.clock, "frontier": dict(e.frontier), "late": dict(e.dropped), "error": repr(self.error) if self.error else None}

    def view(self, name: str) -> DataFrame:
        """A view's rows as of the last committed tick. Ask while paused or drained."""
        return self.engine.snapshot(name)
