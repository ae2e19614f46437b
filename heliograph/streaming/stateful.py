"""Streams that keep state by key: sessions in the order of arrival, debouncing with cancelling, and a ledger of batches.

State processors need a state store with column families; `state_store` sets the one that Spark brings along for the
time of a query's start.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from heliograph.config import DEFAULTS
from heliograph.sources.tables import exists, removed
from heliograph.streaming.events import apply_file_events

#: Buckets of paths by which waits are kept.
BUCKETS = 2048
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class _Sessions(StatefulProcessor):
    """A user's latest time and session number."""

    def __init__(self, gap: float):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.end = handle.getValueState("end", "ts double, session long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["event_id", "ts"])
        known = self.end.get()
        latest, session = known if known is not None else (None, 0)
        sessions = []
        for ts in own["ts"]:
            if latest is None or ts - latest > self.gap:
                session += 1
            latest = ts if latest is None else max(latest, ts)
            sessions.append(session)
        self.end.update((float(latest), int(session)))
        yield own.assign(session=sessions)[["user_id", "event_id", "ts", "session"]]

    def close(self) -> None: ...


def live_sessions(events: DataFrame, gap: float = DEFAULTS.session_gap_s) -> DataFrame:
    """user_id, event_id, ts and session of a stream of events (user_id, event_id, ts in seconds), numbered by user in
    the order of arrival: a new session begins when ts is more than the gap after the latest ts so far.

    What is kept of a user is two numbers. Events of a batch are put in the order of event_id; a batch's events of one user
    meet in one task, so limit the size of batches (maxBytesPerTrigger), and take the batch form for a backlog.
    """
    form = "user_id long, event_id long, ts double, session long"
    return events.select("user_id", "event_id", "ts").groupBy("user_id").transformWithStateInPandas(_Sessions(gap), form, "Append", "None")


class _Debounce(StatefulProcessor):
    """The open waits of a bucket's paths: last event, number of events and deadline of each, and a timer for the earliest deadline."""

    def __init__(self, quiet_ms: int, cancels: tuple[str, ...], by_clock: bool, path: str):
        self.quiet_ms, self.cancels, self.by_clock, self.path = quiet_ms, cancels, by_clock, path

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waits = handle.getValueState("waits", f"path array<{self.path}>, kind array<string>, us array<long>, events array<long>, deadline array<long>")

    def _keep(self, key, before: int | None, waits: pd.DataFrame) -> None:
        """The bucket's open waits from now on. before: the timer that is set."""
        after = int(waits["deadline"].min()) if len(waits) else None
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)
        if after is None:
            self.waits.clear()
        else:
            self.waits.update((self._paths(key, waits), *(waits[c].tolist() for c in ("kind", "us", "events", "deadline"))))

    @staticmethod
    def _paths(key, waits: pd.DataFrame) -> list:
        return [None] * len(waits) if key[0] < 0 else waits["path"].tolist()

    def _told(self, key, waits: pd.DataFrame) -> pd.DataFrame:
        return waits[["kind", "us", "events"]].assign(path=pd.Series(self._paths(key, waits), waits.index, waits["path"].dtype if key[0] >= 0 else object))[["path", "kind", "us", "events"]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows), ignore_index=True).sort_values(["us", "event_id"], ignore_index=True)
        known = self.waits.get()
        open_ = pd.DataFrame(dict(zip(("path", "kind", "us", "events", "deadline"), known or [[]] * 5, strict=True)))
        before = int(open_["deadline"].min()) if len(open_) else None
        code = pd.factorize(pd.concat([open_["path"], own["path"]]) if len(open_) else own["path"], use_na_sentinel=False)[0]
        had, code = code[: len(open_)], code[len(open_) :]
        cancel = own["kind"].isin(self.cancels).to_numpy()
        now = timerValues.getCurrentProcessingTimeInMs() if self.by_clock else None
        if len(open_):  # an event that came late is counted, but neither moves nor cancels what is newer
            live = open_["deadline"].to_numpy() >= now if self.by_clock else np.full(len(open_), True)
            latest = np.full(1 + max(had.max(), code.max()), np.iinfo(np.int64).min)
            latest[had[live]] = open_["us"].to_numpy()[live]
            late = own["us"].to_numpy() < latest[code]
            open_["events"] += np.bincount(code[late & ~cancel], minlength=len(latest))[had]
            own, code, cancel = own[~late], code[~late], cancel[~late]
        at = np.full(len(own), now, np.int64) if self.by_clock else own["us"].to_numpy() // 1000
        own = own[["path", "kind", "us"]].assign(events=1, deadline=at + self.quiet_ms)
        # each path's open wait, then its events in their order; a wait ends by a cancel, or where the next event comes after its deadline
        code, at, cancel = np.concatenate([had, code]), np.concatenate([np.zeros(len(had), np.int64), at]), np.concatenate([np.full(len(had), False), cancel])
        order = np.argsort(code, kind="stable")
        line = (pd.concat([open_, own], ignore_index=True) if len(open_) else own).iloc[order]
        code, at, cancel, deadline = code[order], at[order], cancel[order], line["deadline"].to_numpy()
        other = code[1:] != code[:-1]
        starts = np.concatenate([[0], 1 + np.flatnonzero(other | cancel[:-1] | (at[1:] > deadline[:-1]))])
        ends = np.append(starts[1:], len(line)) - 1
        waits = line.iloc[ends].assign(events=np.add.reduceat(line["events"].to_numpy(), starts))
        last = np.append(other, True)[ends]
        self._keep(key, before, waits[last & ~cancel[ends]])
        if (over := ~last & ~cancel[ends]).any():
            yield self._told(key, waits[over])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waits = pd.DataFrame(dict(zip(("path", "kind", "us", "events", "deadline"), self.waits.get() or [[]] * 5, strict=True)))
        now = timerValues.getCurrentProcessingTimeInMs() if self.by_clock else timerValues.getCurrentWatermarkInMs()
        over = (waits["deadline"] < now) | (waits["deadline"] <= expiredTimerInfo.getExpiryTimeInMs())
        self._keep(key, None, waits[~over])
        if over.any():
            yield self._told(key, waits[over])

    def close(self) -> None: ...


def debounced(events: DataFrame, quiet_s: float = 30.0, cancels: tuple[str, ...] = ("deleted",), late: str | None = "1 minute") -> DataFrame:
    """path, last kind, last ts and number of the events of a stream (path, event_id, kind, ts), once a path has been
    quiet for longer than quiet_s: another event moves the timer, one of the kinds `cancels` takes it away, and then nothing is told.

    With `late`, time is that of events, and what comes later than that after the latest one is dropped; with None it is the clock of the
    machines, so a wait ends even if no further event of any path comes.

    State is kept by buckets of paths, so that a batch costs a few calls for each bucket and not for each path or wait. A bucket's events of a
    batch and its open waits meet in one task. A stream keeps the number of buckets that it was started with.
    """
    own = events.select("path", "event_id", "kind", "ts")
    if late is not None:
        own = own.withWatermark("ts", late)
    kind = own.schema["path"].dataType.simpleString()
    processor = _Debounce(int(quiet_s * 1000), cancels, late is None, kind)
    form = f"path {kind}, kind string, us long, events long"
    bucket = F.when(F.col("path").isNull(), -1).otherwise(F.pmod(F.hash("path"), F.lit(BUCKETS)))  # nulls apart: beside them numbers would lose digits
    told = own.withColumns({"us": F.unix_micros("ts"), "bucket": bucket}).groupBy("bucket").transformWithStateInPandas(processor, form, "Append", "ProcessingTime" if late is None else "EventTime")
    return told.select("path", "kind", F.timestamp_micros("us").alias("ts"), "events")


class FileEventSink:
    """Records as file events leave them, batch by batch, each exactly once; the function for foreachBatch.

    A batch is applied to the snapshot that the one before has left, and written as a snapshot of its own; a ledger entry is
    written last. A batch that runs again before its entry is there writes the same over what it has left; one whose entry is
    there changes nothing. Creations and changes with a poisoned hash (a table `hash`) aren't applied, but kept as dead
    letters. Readers see the last snapshot of the ledger. The latest two snapshots stay, so that a reader of the
    one before isn't cut off.

    Events are path, kind, hash, target and version, as for apply_file_events; records are file_id, path, hash, deleted.
    """

    def __init__(self, folder: str, records: DataFrame, roots: DataFrame | None = None, poisoned: DataFrame | None = None):
        self.folder, self.roots, self.poisoned = folder, roots, poisoned
        self.base, self.spark = records.select("file_id", "path", "hash", "deleted"), records.sparkSession

    def _at(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}/batch={number}"

    def done(self) -> list[int]:
        """Numbers of the batches in the ledger."""
        if not exists(self.spark, f"{self.folder}/ledger"):
            return []
        return sorted(r.number for r in self.spark.read.schema("number long").parquet(f"{self.folder}/ledger/*").collect())

    def records(self) -> DataFrame:
        numbers = self.done()
        return self.spark.read.schema(self.base.schema).parquet(self._at("records", numbers[-1])) if numbers else self.base

    def dead_letters(self) -> DataFrame:
        """Events that weren't applied, with the number of their batch."""
        paths = [self._at("dead", n) for n in self.done()]
        form = "path string, kind string, hash string, target string, version long, number long"
        return self.spark.read.schema(form).parquet(*paths) if paths else self.spark.createDataFrame([], form)

    def __call__(self, batch: DataFrame, number: int) -> None:
        numbers = self.done()
        if number in numbers:
            return
        events = batch.select("path", "kind", "hash", "target", "version")
        bad = events.where("false")
        if self.poisoned is not None:
            known = self.poisoned.select("hash").distinct()
            arrived = events.where("kind in ('created', 'modified')")
            bad = arrived.join(known, "hash", "left_semi").select(*events.columns)
            events = events.where("kind not in ('created', 'modified')").unionByName(arrived.join(known, "hash", "left_anti").select(*events.columns))
        bad.withColumn("number", F.lit(number).cast("long")).write.mode("overwrite").parquet(self._at("dead", number))
        apply_file_events(self.records(), events, self.roots).select(*self.base.columns).write.mode("overwrite").parquet(self._at("records", number))
        self.spark.createDataFrame([(number,)], "number long").write.mode("overwrite").parquet(self._at("ledger", number))
        for old in numbers[:-1]:
            removed(self.spark, self._at("records", old))
