"""Streams with nulls in every column, restarts, expiry, late rows, and merges that are delivered again."""

import time

import pytest
from pyspark.sql import functions as F

from proofmill.sources import sinks
from proofmill.streaming import jobs, run
from proofmill.streaming.run import appended, counted, counting, file_stream, new_home, updated

EVENT = "session_id long, seq long, status string"
READING = "zone_id long, engine string, text string, error string"
DAY = 86_400


def deliver(spark, path, rows, schema):
    """One more delivery of rows (..., seconds), as new files of a folder."""
    timed = spark.createDataFrame(rows, schema + ", s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    timed.coalesce(1).write.mode("append").parquet(path)


def states(df):
    return {(r.session_id, r.done, r.passed, r.manual, r.last_status) for r in df.collect()}


def test_progress_with_nulls(spark, tmp_path):
    rows = [
        (1, 1, "PASS", 100), (1, None, "MANUAL", 100), (1, 2, None, 300), (2, None, None, 100), (3, 1, "a", 100), (3, 1, "b", 100),
        (None, 1, "PASS", 100), (None, None, "done", 200), (4, 1, "PASS", None), (5, None, "x", 50), (5, None, "y", 40),
    ]
    deliver(spark, str(tmp_path / "in"), rows, EVENT)
    got = updated(jobs.progress(file_stream(spark, str(tmp_path / "in"))), ["session_id"], "nulls")
    assert states(got) == {(1, 3, 1, 1, "PASS"), (2, 1, 0, 0, None), (3, 2, 0, 0, "b"), (None, 2, 1, 0, "done"), (5, 2, 0, 0, "x")}
    assert {(r.session_id, r.status) for r in updated(jobs.session_state(file_stream(spark, str(tmp_path / "in"))), ["session_id"], "nulls").collect()} == {(1, "PASS"), (2, None), (3, "b"), (None, "done"), (5, "x")}


def test_a_restarted_stream_goes_on(spark, tmp_path):
    """Stopped after each delivery and started from its checkpoint, it ends as one that never stopped; a session whose time ran out starts anew."""
    parts = [[(1, 1, "PASS", DAY), (1, 2, "MANUAL", DAY + 5), (2, 3, "pending", DAY)], [(2, 4, "PASS", 6 * DAY)], [(2, 5, "PASS", 20 * DAY)], [(1, 6, "PASS", 20 * DAY + 2), (2, 7, "MANUAL", 20 * DAY + 2)]]
    home = new_home(spark, "restart")
    for part in parts:
        deliver(spark, str(tmp_path / "in"), part, EVENT)
        got = updated(jobs.progress(file_stream(spark, str(tmp_path / "in"))), ["session_id"], "restart", home=home)
        time.sleep(1.1)  # files are read in the order of their times
    once = updated(jobs.progress(file_stream(spark, str(tmp_path / "in"), 1)), ["session_id"], "once")
    assert states(got) == states(once) == {(1, 1, 1, 0, "PASS"), (2, 4, 2, 1, "MANUAL")}
    # Started again without new rows, it changes nothing.
    assert states(updated(jobs.progress(file_stream(spark, str(tmp_path / "in"))), ["session_id"], "restart", home=home)) == states(got)


def test_state_does_not_grow_with_sessions_that_are_over(spark, tmp_path):
    home = new_home(spark, "growth")
    for k in range(3):
        deliver(spark, str(tmp_path / "in"), [(100 * k + n, 1, "PASS", (1 + 30 * k) * DAY) for n in range(20)], EVENT)
        query = jobs.progress(file_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("update").option("checkpointLocation", home).trigger(availableNow=True).format("noop").start()
        query.awaitTermination()
        held = query.lastProgress.stateOperators[0].customMetrics
        kept = query.lastProgress.stateOperators[0].numRowsTotal
    # A session's state and the two entries of its timer; those of earlier deliveries are gone.
    assert kept <= 20 * 3, (kept, held)


def test_entries_expire(spark, tmp_path):
    schema = "key string, id string"
    first = [("a", "1", DAY), ("b", "2", DAY), ("b", "3", 5 * DAY), ("c", None, DAY), (None, "4", DAY), ("d", "5", None), ("e", "6", DAY), ("e", "7", 9 * DAY)]
    home = new_home(spark, "entries")
    for part in (first, [("a", "8", 14 * DAY)], [("z", "9", 40 * DAY)]):
        deliver(spark, str(tmp_path / "in"), part, schema)
        got = appended(jobs.expired_entries(file_stream(spark, str(tmp_path / "in"))), "entries", home=home)
    days = lambda t: int(t.timestamp() // DAY)
    found = sorted((r.key, r.id, days(r.created), days(r.expired)) for r in got.collect())
    assert found == [("a", "1", 1, 8), ("a", "8", 14, 21), ("b", "3", 5, 12), ("c", "", 1, 8), ("e", "6", 1, 8), ("e", "7", 9, 16)]


def test_vote_with_nulls(spark, tmp_path):
    rows = [
        (1, "google", "x", None, 1000), (1, "azure", "x", None, None), (1, None, "y", None, 1000), (1, "ocrspace", None, None, 1000), (None, "google", "x", None, 1000),
        (2, "google", None, "failed", None), (2, "azure", None, "failed", 1000), (2, "ocrspace", None, "failed", 1000),
    ]
    deliver(spark, str(tmp_path / "in"), rows, READING)
    got = appended(jobs.streaming_vote(file_stream(spark, str(tmp_path / "in"))), "nulls").collect()
    assert {(r.zone_id, r.text, r.status, r.n_readings, r.n_valid) for r in got} == {(1, "x", "OK", 3, 3), (2, None, "MANUAL", 3, 0)}


@pytest.mark.parametrize("texts", [("b", "a"), ("a", "b")])
def test_two_readings_of_an_engine(spark, tmp_path, texts):
    """Which of them counts doesn't depend on their order, nor on the delivery they come with."""
    home = new_home(spark, "twice")
    for text in texts:
        deliver(spark, str(tmp_path / "in"), [(1, "google", text, None, 1000)], READING)
        appended(jobs.streaming_vote(file_stream(spark, str(tmp_path / "in")), 2), "twice", home=home)
    deliver(spark, str(tmp_path / "in"), [(1, "azure", "a", None, 1000)], READING)
    (got,) = appended(jobs.streaming_vote(file_stream(spark, str(tmp_path / "in")), 2), "twice", home=home).collect()
    assert (got.text, got.rule) == ("a", "match_2")


def test_late_rows_are_counted(spark, tmp_path):
    parts = [[(1, 1, "PASS", 1000), (2, 1, "PASS", None)], [(1, 2, "PASS", 9000)], [(1, 3, "PASS", 1000), (1, 4, "PASS", 1200), (3, 1, "PASS", 8700)]]
    home = new_home(spark, "late")
    found = []
    for part in parts:
        deliver(spark, str(tmp_path / "in"), part, EVENT)
        with counting(spark) as counts:
            got = updated(jobs.progress(counted(file_stream(spark, str(tmp_path / "in")))), ["session_id"], "late", home=home)
            rows = counts.table(spark).collect()
        found.append(tuple(sum(r[c] for r in rows) for c in ("rows", "untimed", "late")))
    assert found == [(2, 1, 0), (1, 0, 0), (3, 0, 2)]
    assert states(got) == {(1, 2, 2, 0, "PASS"), (3, 1, 1, 0, "PASS")}


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_merge_rewrites_touched_partitions(spark, tmp_path):
    path = tmp_path / "store"
    rows = spark.range(400).select(F.col("id").alias("k"), F.lit(1).alias("ts"), F.lit("old").alias("v"))
    assert sinks.merge(rows, str(path), ["k"], batch=1)
    before = files(path)
    assert len(before) == sinks.BUCKETS
    one = spark.createDataFrame([(7, 2, "new"), (7, 1, "between"), (7, 0, "older")], "k long, ts int, v string")
    assert sinks.merge(one, str(path), ["k"], batch=2)
    after = files(path)
    assert len(before.keys() & after.keys()) == sinks.BUCKETS - 1
    assert all(before[k] == after[k] for k in before.keys() & after.keys())
    stored = sinks.merged(spark, str(path))
    assert stored.columns == ["k", "ts", "v"]
    assert {(r.k, r.v) for r in stored.collect()} == {(k, "new" if k == 7 else "old") for k in range(400)}


def test_merge_again_changes_nothing(spark, tmp_path):
    path = tmp_path / "store"
    batch = spark.createDataFrame([(1, 5, "a"), (None, 5, "n"), (2, None, "b")], "k long, ts int, v string")
    assert sinks.merge(batch, str(path), ["k"], batch=0)
    assert sinks.merge(spark.createDataFrame([(1, 6, "c"), (2, 1, "d")], "k long, ts int, v string"), str(path), ["k"], batch=1)
    before = files(path)
    assert not sinks.merge(batch, str(path), ["k"], batch=0)
    assert not sinks.merge(batch, str(path), ["k"], batch=1)
    assert files(path) == before
    # One that failed before it was recorded is merged again, with the same rows in the end.
    assert sinks.merge(batch, str(path), ["k"])
    assert {(r.k, r.v) for r in sinks.merged(spark, str(path)).collect()} == {(1, "c"), (None, "n"), (2, "d")}
    assert not sinks.merge(batch.limit(0), str(path), ["k"], batch=3)
    with pytest.raises(ValueError, match="buckets"):
        sinks.merge(batch, str(path), ["k"], buckets=3)


def test_an_empty_store(spark, tmp_path):
    sinks.merge(spark.createDataFrame([], "k long, ts int"), str(tmp_path / "store"), ["k"], batch=0)
    assert sinks.merged(spark, str(tmp_path / "store")).count() == 0


def test_chunks_fill_up_over_deliveries(spark, tmp_path):
    """16 requests are one chunk, however they were delivered; what is left goes out once its time is over, each request once."""
    schema = "session_id long, mode string, seq long"
    home = new_home(spark, "chunks")
    parts = [
        [(1, "a", n, DAY + n) for n in range(10)] + [(1, None, 5, DAY), (None, "a", None, DAY), (2, "b", 1, None)],
        [(1, "a", n, DAY + n) for n in range(10, 30)],
        [(9, "z", 0, 3 * DAY)],
        [(1, "a", 99, 3 * DAY)],
        [(9, "z", 1, 9 * DAY)],
    ]
    sizes = []
    for part in parts:
        deliver(spark, str(tmp_path / "in"), part, schema)
        stream = jobs.carried_batches(file_stream(spark, str(tmp_path / "in")), "1 hour", lanes=1)
        got = appended(stream, "chunks", home).collect()
        sizes.append(sorted(len(r.requests) for r in got if r.session_id == 1 and r.mode == "a"))
        time.sleep(1.1)
    assert sizes == [[], [16], [14, 16], [14, 16], [1, 14, 16]]
    assert sorted(n for r in got if r.session_id == 1 and r.mode == "a" for n in r.requests) == [*range(30), 99]
    assert {(r.session_id, r.mode, r.chunk, *r.requests) for r in got if r.session_id != 1 or r.mode is None} == {(1, None, 0, 5), (None, "a", 0, None)}  # 9's second request came before the watermark passed its time
    assert sorted(r.chunk for r in got if r.session_id == 1 and r.mode == "a") == [0, 0, 1]


def test_keys_share_calls_to_the_state(spark, tmp_path, monkeypatch):
    """The entries of the state, and the calls that make them, follow the groups of keys, not the keys."""
    monkeypatch.setattr(jobs, "GROUPS", 4, raising=False)
    run._stateful(spark)
    deliver(spark, str(tmp_path / "in"), [(n, "a", n, DAY) for n in range(200)], "session_id long, mode string, seq long")
    stream = jobs.carried_batches(file_stream(spark, str(tmp_path / "in")), "1 hour", lanes=1)
    query = stream.writeStream.outputMode("append").option("checkpointLocation", new_home(spark, "calls")).trigger(availableNow=True).format("noop").start()
    query.awaitTermination()
    # A group's state and the two entries of its timer.
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 4 * 3


@pytest.mark.parametrize("groups", [1, 2048])
def test_chunks_of_keys_in_one_group(spark, tmp_path, monkeypatch, groups):
    """Keys of a group end each at its own time, also when others of it go on; nulls and large numbers stay what they are."""
    monkeypatch.setattr(jobs, "GROUPS", groups, raising=False)
    big = 2**53 + 1
    parts = [
        [(big, 'a"\\', big + 2, DAY), (None, None, None, DAY), (3, "", 3, DAY + 7200), (3, None, None, DAY + 7200)],
        [(4, "a", 4, DAY + 7300)],
        [(3, "", 5, DAY + 9000)],
        [(4, "a", 6, DAY + 11500)],
        [(9, "z", 1, DAY + 13300)],
    ]
    home = new_home(spark, "group")
    found = []
    for part in parts:
        deliver(spark, str(tmp_path / "in"), part, "session_id long, mode string, seq long")
        got = appended(jobs.carried_batches(file_stream(spark, str(tmp_path / "in")), "1 hour", lanes=1), "group", home)
        found.append({(r.session_id, r.mode, r.lane, r.chunk, *r.requests) for r in got.collect()})
        time.sleep(1.1)
    over = {(big, 'a"\\', 0, 0, big + 2), (None, None, 0, 0, None)}
    late = over | {(3, None, 0, 0, None)}
    assert found == [over, over, over, late, late | {(3, "", 0, 0, 3, 5)}]
    assert got.count() == len(found[-1])


def test_sessions_share_calls_to_the_state(spark, tmp_path, monkeypatch):
    """All sessions are one group: each ends at its own time, and the group's state and timer are few entries."""
    monkeypatch.setattr(jobs, "GROUPS", 1, raising=False)
    big = 2**53 + 1
    parts = [
        [(n, 1, "PASS", DAY) for n in range(50)] + [(big, big, "MANUAL", DAY), (None, None, None, 4 * DAY)],
        [(1, 2, "x", 8 * DAY + 600)],
        [(None, 3, "y", 8 * DAY + 700), (2, 4, "z", 9 * DAY)],
        [(1, 5, "v", 12 * DAY), (None, 6, "w", 20 * DAY)],
    ]
    home = new_home(spark, "sessions")
    for part in parts:
        deliver(spark, str(tmp_path / "in"), part, EVENT)
        got = updated(jobs.progress(file_stream(spark, str(tmp_path / "in"))), ["session_id"], "sessions", home=home)
        time.sleep(1.1)
    found = states(got)
    assert {s for s in found if s[0] not in range(3, 50)} == {(0, 1, 1, 0, "PASS"), (1, 3, 1, 0, "v"), (2, 1, 0, 0, "z"), (big, 1, 0, 1, "MANUAL"), (None, 3, 0, 0, "w")}
    assert len(found) == 52
    query = jobs.progress(file_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("update").option("checkpointLocation", new_home(spark, "sessions")).trigger(availableNow=True).format("noop").start()
    query.awaitTermination()
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 3
