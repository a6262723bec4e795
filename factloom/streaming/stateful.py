"""Stateful streams: state changes, state of runs and expiry of idle keys, with the state of one key at a time in the state store.

Each operator serves a batch and a stream. On a stream, rows of a key are taken in the order of ``ts`` and ``event_id`` within a
trigger, and triggers in their order; a row older than the last one taken of its key is late and passed over, so a file
source that appears in time order gives the rows of the batch. What a key keeps is a few values, never its rows; the
rows of a key in one trigger are bounded by the source's rate limit. Rows with a null key or time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: The provider that keeps state outside the heap and that stateful processors need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(rows: Iterator[pd.DataFrame], after: tuple | None) -> pd.DataFrame:
    """The rows of one key in one trigger, in order, without those at or before ``after``."""
    part = pd.concat(list(rows), ignore_index=True).sort_values(["at", "event_id"], kind="stable")
    if after is None:
        return part
    return part[(part["at"] > after[0]) | ((part["at"] == after[0]) & (part.event_id > after[1]))]


class Changes(StatefulProcessor):
    """STM4: keeps the last state, and gives the rows that differ from the one before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "state string, at long, event_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        part = in_order(rows, held and (held[1], held[2]))
        if len(part):
            was = part.state.shift(1)
            was.iloc[0] = held[0] if held else None
            change = was.notna() & (was != part.state)
            end = part.iloc[-1]
            self.last.update((None if pd.isna(end.state) else end.state, int(end["at"]), int(end.event_id)))
            yield pd.DataFrame({"key": key[0], "at": part["at"], "event_id": part.event_id, "was": was, "state": part.state})[change]

    def close(self) -> None:
        pass


class Runs(StatefulProcessor):
    """STM5: keeps the last status of each step of the ``keep`` runs of an owner that moved last; older runs are told as dropped, once, and forgotten."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "at long, event_id long")
        self.moved = handle.getMapState("moved", "run string", "at long, event_id long")
        self.steps = handle.getMapState("steps", "run string, step string", "status string, at long, event_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.at.get() if self.at.exists() else None
        part = in_order(rows, held and (held[0], held[1]))
        if not len(part):
            return
        last = part.groupby(["run", "step"], sort=False).tail(1)
        for r in last.itertuples():
            self.steps.updateValue((r.run, r.step), (r.status, int(r.at), int(r.event_id)))
            self.moved.updateValue((r.run,), (int(r.at), int(r.event_id)))
        end = part.iloc[-1]
        self.at.update((int(end["at"]), int(end.event_id)))
        runs = sorted(((v[0], v[1], k[0]) for k, v in self.moved.iterator()), reverse=True)
        gone = {run for _, _, run in runs[self.keep :]}
        made = [(r.run, r.step, r.status, r.at, r.event_id, True) for r in last.itertuples() if r.run not in gone]
        if gone:
            for (run, step), (status, at, event_id) in [(tuple(k), tuple(v)) for k, v in self.steps.iterator() if k[0] in gone]:
                made.append((run, step, status, at, event_id, False))
                self.steps.removeKey((run, step))
            for run in gone:
                self.moved.removeKey((run,))
        if made:
            out = pd.DataFrame(made, columns=["run", "step", "status", "at", "event_id", "kept"])
            out.insert(0, "key", key[0])
            yield out

    def close(self) -> None:
        pass


class Idle(StatefulProcessor):
    """STM7: keeps when a key was last seen; a timer set ``idle_ms`` after that ends its visit and frees the state."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.visit = handle.getValueState("visit", "start long, end long, event_id long, n long")

    def due(self, end: int) -> int:
        return -(-end // 1000) + self.idle_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.visit.get() if self.visit.exists() else None
        part = in_order(rows, held and (held[1], held[2]))
        if not len(part):
            return
        if held:
            self.handle.deleteTimer(self.due(held[1]))
        start, end, event_id, n = held or (None, None, None, 0)
        done = []
        for at, own in zip(part["at"].tolist(), part.event_id.tolist()):
            if start is not None and at - end >= self.idle_ms * 1000:
                done.append((key[0], start, end, event_id, n))
                start, n = None, 0
            start, end, event_id, n = (at if start is None else start), at, own, n + 1
        self.visit.update((start, end, event_id, n))
        self.handle.registerTimer(self.due(end))
        if done:
            yield pd.DataFrame(done, columns=["key", "start", "end", "event_id", "n"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.visit.exists():
            visit = self.visit.get()
            self.visit.clear()
            yield pd.DataFrame([(key[0], *visit)], columns=["key", "start", "end", "event_id", "n"])

    def close(self) -> None:
        pass


def _sound(events: DataFrame, by: str, *columns) -> DataFrame:
    """Times also as microseconds, so that no state depends on the session's time zone."""
    ts = F.col("ts").cast("timestamp")
    return events.select(F.col(by).cast("string").alias("key"), ts.alias("ts"), F.unix_micros(ts).alias("at"), F.col("event_id").cast("long").alias("event_id"), *columns).where("key is not null and ts is not null and event_id is not null")


def _timed(made: DataFrame, **names: str) -> DataFrame:
    return made.select(*[F.timestamp_micros(c).alias(names[c]) if c in names else c for c in made.columns])


def state_changes(events: DataFrame, by: str, state: str) -> DataFrame:
    """STM4: (key, ts, event_id, was, state): the rows of ``events`` (by, state, ts, event_id) whose state differs from the one before; after a null state nothing is a change."""
    rows = _sound(events, by, F.col(state).alias("state"))
    if rows.isStreaming:
        return _timed(rows.groupBy("key").transformWithStateInPandas(Changes(), "key string, at long, event_id long, was string, state string", "Append", "None"), at="ts")
    was = F.lag("state").over(Window.partitionBy("key").orderBy("at", "event_id"))
    return rows.withColumn("was", was).where(F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col("state"))).select("key", "ts", "event_id", "was", "state")


def run_states(events: DataFrame, owner: str, run: str, keep: int = 50) -> DataFrame:
    """STM5: (key, run, step, status, ts, event_id, kept): the last status of each step (step, status, ts, event_id) of a run, for the ``keep`` runs an owner that moved last.

    A batch gives all runs, older ones with ``kept`` false. A stream gives a row whenever one changes, and a last one with
    ``kept`` false when its run is forgotten; a run that moves again after that begins anew.
    """
    rows = _sound(events, owner, F.col(run).cast("string").alias("run"), "step", "status").where("run is not null and step is not null")
    if rows.isStreaming:
        return _timed(rows.groupBy("key").transformWithStateInPandas(Runs(keep), "key string, run string, step string, status string, at long, event_id long, kept boolean", "Update", "None"), at="ts")
    last = rows.groupBy("key", "run", "step").agg(F.max(F.struct("ts", "event_id", "status")).alias("l")).select("key", "run", "step", "l.status", "l.ts", "l.event_id")
    runs = last.groupBy("key", "run").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("m"), F.desc("run")))
    return last.join(runs.select("key", "run", (place <= keep).alias("kept")), ["key", "run"]).select("key", "run", "step", "status", "ts", "event_id", "kept")


def released(events: DataFrame, by: str, idle: int, delay: str = "0 seconds") -> DataFrame:
    """STM7: (key, start, end, event_id, n): visits of a key that ended because nothing came for ``idle`` seconds, by the newest time seen anywhere.

    A stream ends a visit by a timer on the watermark, which follows the newest time at ``delay``; a batch compares with that
    time itself, in whole milliseconds like the watermark. Visits that may still go on are not given.
    """
    rows = _sound(events, by)
    if rows.isStreaming:
        made = rows.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(Idle(idle * 1000), "key string, start long, end long, event_id long, n long", "Append", "EventTime")
        return _timed(made, start="start", end="end")
    w = Window.partitionBy("key").orderBy("at", "event_id")
    new = F.coalesce(F.col("at") - F.lag("at").over(w) >= idle * 1_000_000, F.lit(True)).cast("int")
    numbered = rows.withColumn("__new", new).withColumn("__visit", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    visits = numbered.groupBy("key", "__visit").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.max(F.struct("at", "event_id")).alias("l"), F.count(F.lit(1)).alias("n"))
    newest = rows.agg(F.floor(F.max("at") / 1000).alias("__now"))  # one row
    more = F.lead("start").over(Window.partitionBy("key").orderBy("__visit")).isNotNull()
    over = F.col("__more") | (F.ceil(F.col("l.at") / 1000) + idle * 1000 <= F.col("__now"))
    return visits.withColumn("__more", more).crossJoin(F.broadcast(newest)).where(over).select("key", "start", "end", "l.event_id", "n")


def write_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and gives all that ``path`` then holds, with the number of its ``trigger``.

    A trigger writes its own folder anew, so one that is repeated after a loss or a restart doubles nothing.
    """

    def put(rows: DataFrame, trigger: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/trigger={trigger}")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)
