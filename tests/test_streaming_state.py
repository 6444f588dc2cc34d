"""Durable tables over restarts, syncs that may fail, and version state over any split of a stream."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from marlspark.sources.manifest import Manifests
from marlspark.streaming import changes, triggers, versions
from marlspark.streaming.table import DurableTable, synchronise

SCHEMA = "k int, at int, v string, gone boolean, digest string"


def rows(spark, *given):
    return spark.createDataFrame([(k, at, v, gone, f"{k}-{at}-{v}") for k, at, v, gone in given], SCHEMA)


def table(spark, path):
    return DurableTable(spark, str(path), ["k"], ["at"], SCHEMA, buckets=8)


def held(t):
    return {(r.k, r.v) for r in t.read().collect()}


def test_a_stop_between_data_and_manifest(spark, tmp_path, monkeypatch):
    first = table(spark, tmp_path)
    assert held(first) == set() and first.upsert(rows(spark, (1, 1, "a", False), (2, 1, "b", None)), 0)
    publish = Manifests.publish

    def dies(self, number, content):
        raise OSError("the driver is lost")

    monkeypatch.setattr(Manifests, "publish", dies)
    second = rows(spark, (1, 2, "c", False), (3, 1, "d", False))
    with pytest.raises(OSError):
        first.upsert(second, 1)
    monkeypatch.setattr(Manifests, "publish", publish)
    again = table(spark, tmp_path)  # a new driver
    assert held(again) == {(1, "a"), (2, "b")}
    assert again.upsert(second, 1) and held(again) == {(1, "c"), (2, "b"), (3, "d")}
    assert not again.upsert(rows(spark, (1, 9, "never", False)), 1) and held(again) == {(1, "c"), (2, "b"), (3, "d")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, *[(i, 1, "x", False) for i in range(100)]), 0)
    before = t._state()[1]["files"]
    t.upsert(rows(spark, (7, 2, "y", False)), 1)
    after = t._state()[1]["files"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert (7, "y") in held(t) and t.read().count() == 100


def test_removed_keys_stay_out(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, (1, 5, "a", False), (2, 5, "b", False)), 0)
    t.upsert(rows(spark, (1, 6, None, True)), 1)
    t.upsert(rows(spark, (1, 5, "late", False), (1, 4, "a", False)), 2)
    assert held(t) == {(2, "b")} and t.history().count() == 2
    t.upsert(rows(spark, (1, 7, "back", False)), 3)
    assert held(t) == {(1, "back"), (2, "b")}


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    schema = "k int, at int, v string, gone boolean"
    for i in range(2):
        spark.createDataFrame([(1, i, f"v{i}", False), (i + 2, i, "w", False)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")

    def run():
        t = table(spark, tmp_path / "t")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/part=*")
        changes.run_to_end(changes.fingerprinted(stream, ["k", "at", "v"]), lambda b, n: t.upsert(b, n), "s", offsets=f"{tmp_path}/offsets")
        return t

    assert held(run()) == {(1, "v1"), (2, "w"), (3, "w")}
    version = table(spark, tmp_path / "t").version
    assert run().version == version  # nothing new
    spark.createDataFrame([(1, 9, "v9", False)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part=2")
    assert held(run()) == {(1, "v9"), (2, "w"), (3, "w")}


def test_bootstrap_catch_up_and_failures(spark, tmp_path):
    t = table(spark, tmp_path)
    day = lambda n: dt.datetime(2024, 1, n)
    log = [(1, 1, "a"), (2, 2, "b"), (1, 5, "c"), (3, 8, "d")]
    at = lambda end: rows(spark, *[(k, d, v, False) for k, d, v in log if day(d) <= end])
    between = lambda start, end: rows(spark, *[(k, d, v, False) for k, d, v in log if start < day(d) <= end])
    times = iter(day(n) for n in (3, 3, 3, 6, 9, 9))
    with pytest.raises(RuntimeError):
        synchronise(t, at, between, lambda: next(times), failures=lambda rows: 1)
    assert t.checkpoint is None and t.version == 0
    assert synchronise(t, at, between, lambda: next(times), dry_run=True) == {"full": 2, "delta": 0} and t.version == 0
    audits = []
    done = synchronise(t, at, between, lambda: next(times), audit=lambda rows: audits.append(rows.count()))
    assert done == {"full": 2, "delta": 1} and audits == [2, 1]
    assert t.checkpoint == day(6) and held(t) == {(1, "c"), (2, "b")}

    def fails(rows):
        raise OSError("no audit")

    with pytest.raises(OSError):
        synchronise(t, at, between, lambda: next(times), audit=fails)
    assert t.checkpoint == day(6)
    assert synchronise(table(spark, tmp_path), at, between, lambda: next(times)) == {"full": 0, "delta": 1}
    assert held(t) == {(1, "c"), (2, "b"), (3, "d")} and t.checkpoint == day(9)


FILES = "source long, document_code string, seq long, file_id long, version int, slug string, checksum string"


def test_versions_over_any_split(spark, tmp_path):
    given = [(0, "A", 2, "s", "x"), (0, "A", 1, "s", "x"), (0, "A", 1, "s", "x"), (0, "A", 1, "s", "y"), (1, "A", 1, "s", "x"), (0, "A", 3, "t", "x"), (0, "A", 3, "s", "x"), (0, "A", 2, "s", "z"), (0, "B", 1, "u", "x"), (0, "A", 3, "s", "q")]
    want = ["INITIAL_VERSION_MUST_BE_ONE", "CREATE", "DUPLICATE", "VERSION_CONTENT_CONFLICT", "CREATE", "DOCUMENT_NAME_MISMATCH", "NEW_VERSION", "OLDER_VERSION", "CREATE", "VERSION_CONTENT_CONFLICT"]
    known, latest = {}, {}
    for (source, code, version, slug, checksum), outcome in zip(given, want, strict=True):
        key = (source, code)
        assert versions.decide(version, slug, checksum, latest.get(key), known.get((key, version))) == outcome
        if outcome in ("CREATE", "NEW_VERSION"):
            latest[key], known[key, version] = (version, slug), checksum
    files = [(s, c, i, i, v, slug, x) for i, (s, c, v, slug, x) in enumerate(given)]
    for cut in (0, 3, 7):
        parts = [p for p in (files[:cut], files[cut:]) if p]
        for i, part in enumerate(parts):
            spark.createDataFrame(part, FILES).coalesce(1).write.parquet(f"{tmp_path}/{cut}/part={i}")
        stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{cut}/part=*")
        path, write = changes.append_to(spark, "versions-test")
        changes.run_to_end(versions.judged(stream), write, "versions-test", "update", settings=dict([versions.STORE]))
        found = spark.read.parquet(f"{path}/batch=*")
        assert [r.outcome for r in found.orderBy(F.col("file_id")).collect()] == want


def test_triggers_by_a_memory_clock():
    minute, hour = triggers.MINUTE, 60 * triggers.MINUTE
    state, kind = triggers.claim(triggers.Trigger(), 0)
    assert kind == "scheduled" and state.running and triggers.next_due(state, 0) is None
    assert triggers.claim(triggers.apply(state, "request", 1), 1)[1] is None  # a running run isn't overridden
    failed = triggers.apply(state, "failed", 10 * minute)
    assert triggers.claim(failed, 24 * minute)[1] is None and triggers.next_due(failed, 11 * minute) == 25 * minute
    assert triggers.claim(failed, 25 * minute)[1] == "scheduled"
    asked = triggers.apply(failed, "request", 12 * minute)
    state, kind = triggers.claim(asked, 12 * minute)
    assert kind == "manual" and not state.requested
    done = triggers.apply(state, "done", 20 * minute)
    assert done.retry_after is None and triggers.next_due(done, 21 * minute) == 20 * minute + 6 * hour
    assert triggers.claim(done, 6 * hour)[1] is None and triggers.claim(done, 6 * hour + 20 * minute)[1] == "scheduled"
    off = triggers.apply(done, "disable", 30 * minute)
    assert triggers.next_due(off, 0) is None and triggers.claim(off, 99 * hour)[1] is None and triggers.claim(triggers.apply(off, "request", 0), 0)[1] == "manual"
    assert triggers.apply(done, "failed", 40 * minute) == done  # no run was on
    with pytest.raises(ValueError):
        triggers.apply(done, "other", 0)


def test_a_timer_begins_a_run_without_an_event(spark, tmp_path):
    """A run that ended six hours, less two seconds, ago comes due by the clock."""
    now = int(time.time() * 1_000_000)
    start = now - 6 * 60 * triggers.MINUTE + 2_000_000
    schema = "source long, at long, seq long, kind string"
    spark.createDataFrame([(1, start - 1, 0, "look"), (1, start, 1, "done"), (2, start, 2, "disable")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set(*versions.STORE)
    found = []
    try:
        stream = triggers.runs(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), timers=True)
        query = stream.writeStream.foreachBatch(lambda rows, n: found.extend(map(tuple, rows.collect()))).outputMode("update").option("checkpointLocation", str(tmp_path / "offsets")).trigger(processingTime="1 second").start()
        until = time.time() + 60
        while len(found) < 2 and time.time() < until and query.isActive:
            time.sleep(0.5)
        query.stop()
    finally:
        spark.conf.unset(versions.STORE[0])
    assert [(s, k) for s, _, k in found] == [(1, "scheduled"), (1, "scheduled")]
    assert found[0][1] == start - 1 and start + 6 * 60 * triggers.MINUTE <= found[1][1] < now + 70_000_000
