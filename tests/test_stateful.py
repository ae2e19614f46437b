"""Streams with state: cancelled waits, the clock's time, replayed and broken batches."""

import time

import pytest

from heliograph.plans import source_queries
from heliograph.streaming import stateful


def test_a_cancelled_wait_tells_nothing(spark, tmp_path):
    """By the clock: b ends although no further event comes; a is cancelled in a later batch; c is moved on."""
    form = "path string, event_id long, kind string, ts timestamp"

    def arrive(*rows):
        spark.createDataFrame([(p, k, kind) for k, (p, kind) in enumerate(rows)], "path string, event_id long, kind string").selectExpr("path", "event_id", "kind", "current_timestamp() as ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    arrive(("a", "modified"), ("b", "modified"), ("b", "created"), ("c", "modified"))
    stream = stateful.debounced(spark.readStream.schema(form).parquet(f"{tmp_path}/in"), 25, late=None)
    with stateful.state_store(spark):
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 150
        while not query.recentProgress and time.time() < end:
            time.sleep(0.2)
        arrive(("a", "deleted"), ("c", "created"))
        got = []
        while len(got) < 2 and time.time() < end:
            time.sleep(1)
            query.exception() and pytest.fail(str(query.exception()))
            got = spark.read.schema("path string, kind string, ts timestamp, events long").parquet(f"{tmp_path}/out").collect() if (tmp_path / "out").exists() else []
        time.sleep(3)
        got = spark.read.schema("path string, kind string, ts timestamp, events long").parquet(f"{tmp_path}/out").collect()
    finally:
        query.stop()
    assert sorted((r.path, r.kind, r.events) for r in got) == [("b", "created", 2), ("c", "created", 2)]


def test_events_of_one_batch_wait_and_cancel_in_their_order(spark):
    rows = [("a", 1, "m", 0), ("a", 2, "m", 20), ("a", 3, "m", 51), ("b", 4, "m", 0), ("b", 5, "deleted", 5), ("b", 6, "m", 6), ("c", 7, "deleted", 0), ("d", 8, "m", 9), ("d", 9, "deleted", 3), ("e", 10, "m", 0), ("e", 11, "deleted", 31), ("z", 12, "m", 900)]
    frame = spark.createDataFrame(rows, "path string, event_id long, kind string, s long").selectExpr("path", "event_id", "kind", "timestamp_seconds(86400 + s) as ts")
    got = source_queries._streamed(spark, frame, lambda stream: stateful.debounced(stream, 30, late="1 second")).collect()
    assert sorted((r.path, int(r.ts.timestamp()) % 86400, r.events) for r in got) == [("a", 20, 2), ("a", 51, 1), ("b", 6, 1), ("d", 9, 1), ("e", 0, 1)]


def test_a_batch_that_broke_before_its_ledger_runs_again(spark, tmp_path):
    form = "file_id string, path string, hash string, deleted boolean"
    records = spark.createDataFrame([("1", "/a", "x", False), ("2", "/b", "y", False)], form)
    events = "path string, kind string, hash string, target string, version long"
    batch = spark.createDataFrame([("/a", "moved", None, "/c", 1), ("/d", "created", "z", None, 1), ("/b", "modified", "bad", None, 1)], events)
    sink = stateful.FileEventSink(str(tmp_path), records, poisoned=spark.createDataFrame([("bad",)], "hash string"))
    at = sink._at
    sink._at = lambda kind, number: at(kind, number) if kind != "ledger" else 1 / 0
    with pytest.raises(ZeroDivisionError):
        sink(batch, 0)
    sink._at = at
    assert sink.done() == [] and sink.records().count() == 2 and sink.dead_letters().count() == 0
    for _ in range(2):
        sink(batch, 0)
    assert sorted((r.path, r.hash, r.deleted) for r in sink.records().collect()) == [("/b", "y", False), ("/c", "x", False), ("/d", "z", False)]
    assert [(r.path, r.hash, r.number) for r in sink.dead_letters().collect()] == [("/b", "bad", 0)]
    sink(spark.createDataFrame([("/c", "deleted", None, None, 2)], events), 1)
    assert sorted((r.path, r.deleted) for r in sink.records().collect()) == [("/b", False), ("/c", True), ("/d", False)]
    assert sink.done() == [0, 1]


def test_waits_of_many_paths_are_a_few_entries_of_state(spark, tmp_path, monkeypatch):
    """Forty open waits, one of them of a null path, in four buckets and that of nulls; large numbers keep their digits."""
    monkeypatch.setattr(stateful, "BUCKETS", 4, raising=False)
    paths = [None, *(2**60 + p for p in range(39))]
    spark.createDataFrame([(p, k, "m", k) for k in range(3) for p in paths], "path long, event_id long, kind string, s long").selectExpr("path", "event_id", "kind", "timestamp_seconds(86400 + s) as ts").write.parquet(f"{tmp_path}/in")
    stream = stateful.debounced(spark.readStream.schema("path long, event_id long, kind string, ts timestamp").parquet(f"{tmp_path}/in"), 30, late="1 second")

    def run():
        with stateful.state_store(spark):
            query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            query.awaitTermination()
        return max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)

    assert run() <= 5
    spark.createDataFrame([(1, 3, "m", 500)], "path long, event_id long, kind string, s long").selectExpr("path", "event_id", "kind", "timestamp_seconds(86400 + s) as ts").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = spark.read.schema("path long, kind string, ts timestamp, events long").parquet(f"{tmp_path}/out").collect()
    assert sorted((r.path or 0, r.kind, int(r.ts.timestamp()) % 86400, r.events) for r in got) == sorted((p or 0, "m", 2, 3) for p in paths)


class _Kept:
    """A value of state, and the timers that are set."""

    value, timers = None, ()

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers = {*self.timers, at}

    def deleteTimer(self, at):
        self.timers = self.timers - {at}

    def getCurrentProcessingTimeInMs(self):
        return self.value

    getCurrentWatermarkInMs = getExpiryTimeInMs = getCurrentProcessingTimeInMs


def _now(at):
    out = _Kept()
    out.value = at
    return out


@pytest.mark.parametrize("by_clock", [False, True])
def test_a_bucket_is_its_paths_one_by_one(by_clock):
    """Random batches with late events, ties and nulls, against a loop over each path's events."""
    import random

    import pandas as pd

    rng = random.Random(5)
    for key in (0,), (-1,):
        own, waits, now = stateful._Debounce(1000, ("x", "y"), by_clock, "string"), {}, 5_000
        own.waits, own.handle = _Kept(), _Kept()
        got, want = [], []
        for _ in range(300):
            now += rng.choice([1, 300, 1000, 1001, 4000])
            batch = [(None if key[0] < 0 else rng.choice("abcde"), k, rng.choice(["m", "n", None, "x"]), 1000 * (now + rng.randrange(-1500, 1500)) + rng.randrange(2)) for k in range(rng.randrange(1, 25))]
            for path, _, kind, us in sorted(batch, key=lambda r: (r[3], r[1])):
                wait, at = waits.get(path), now if by_clock else us // 1000
                if wait and at > wait[3]:
                    want.append((path, *wait[:3]))
                    wait = None
                newer = wait is None or us >= wait[1]
                if kind in ("x", "y"):
                    wait = None if newer else wait
                else:
                    wait = (kind, us, 1 + (wait[2] if wait else 0), at + 1000) if newer else (*wait[:2], wait[2] + 1, wait[3])
                waits[path] = wait
            frame = pd.DataFrame(batch, columns=["path", "event_id", "kind", "us"])
            told = [*own.handleInputRows(key, iter([frame[:3], frame[3:]] if len(frame) > 3 else [frame]), _now(now))]
            assert len(told) <= 1 and len(own.handle.timers) <= 1
            for at in [t for t in own.handle.timers if t < now]:
                own.handle.timers -= {at}
                told += own.handleExpiredTimer(key, _now(now), _now(at))
            want += [(path, *wait[:3]) for path, wait in waits.items() if wait and wait[3] < now]
            waits = {path: wait for path, wait in waits.items() if wait and wait[3] >= now}
            got += [r for f in told for r in f.itertuples(index=False, name=None)]
            assert {*own.handle.timers} == ({min(w[3] for w in waits.values())} if waits else set())
        assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) > 50
