"""Subscribers' streams with late, repeated and restarted input, idle times and deletions."""

import datetime
import time

import pytest
from pyspark.sql import types as T

from parlance.operators import jobs
from parlance.streaming import events as S
from parlance.streaming import subscriptions as U
from tests.test_streams import SCHEMA, job, logged

NONE = datetime.datetime(2024, 1, 1)


def put(spark, rows, at, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)


def stream(spark, at, schema=SCHEMA):
    """All files that are there by then, as one batch."""
    spark.createDataFrame([], schema).write.mode("append").parquet(at)
    return S.read(spark, at, spark.read.parquet(at).schema, files_a_batch=1000)


def with_batch(df):
    return T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])


def run(df, at):
    """One run of the stream from its checkpoint; what it gave so far, by batch."""
    S.fan_out(df, {"out": f"{at}/out"}, f"{at}/state", "append").trigger(availableNow=True).start().awaitTermination()
    out = df.sparkSession.read.schema(with_batch(df)).parquet(f"{at}/out")
    return sorted((r.asDict() for r in out.collect()), key=lambda r: r["batch"])


def test_late_events_come_once_and_in_order(spark, tmp_path):
    """The stream restarts between batches; a gap holds what follows it until the missing event comes."""
    rows, got = job(1, 1), []
    for own in ([rows[k] for k in (0, 1, 2, 4)], [rows[3], rows[5]], [rows[2], rows[8], rows[10]], [rows[7], rows[9]], [rows[6]], [rows[4]]):
        put(spark, own, f"{tmp_path}/log")
        got = run(U.tail(stream(spark, f"{tmp_path}/log"), None), tmp_path)
    assert [r["seq"] for r in got] == list(range(11))
    assert [r["closes"] for r in got] == [False] * 10 + [True]
    assert len({r["batch"] for r in got}) == 3  # 0-2, 3-5, and the rest when 6 came


def test_a_subscriber_gets_each_event_once_up_to_the_end(spark, tmp_path):
    one, two = job(1, 1), job(1, 2, None)
    after = [(1, 1, 11, one[0][3], "stage_started", 0, 0.0)]
    batches = [one[:4] + two[:6], one[2:8] + two[:3], one[8:] + two[6:], after + one]
    got = sorted(run(U.tail(logged(spark, f"{tmp_path}/log", batches), None), tmp_path), key=lambda r: (r["job_id"], r["batch"], r["seq"]))
    assert [(x["job_id"], x["seq"]) for x in got] == [(1, k) for k in range(11)] + [(2, k) for k in range(10)]
    assert [x["closes"] for x in got] == [False] * 10 + [True] + [False] * 10


def test_nothing_after_the_end(spark, tmp_path):
    rows = job(1, 1)
    after = [(1, 1, 11, rows[0][3], "stage_started", 0, 0.0), (1, 1, 12, rows[0][3], "job_failed", None, None)]
    put(spark, rows + after, f"{tmp_path}/log")
    run(U.tail(stream(spark, f"{tmp_path}/log"), None), tmp_path)
    put(spark, rows + after, f"{tmp_path}/log")
    got = run(U.tail(stream(spark, f"{tmp_path}/log"), None), tmp_path)
    assert [r["seq"] for r in got] == list(range(11))


def test_idle_times_ping_and_release_what_waits(spark, tmp_path):
    rows = job(1, 1) + job(1, 2)
    put(spark, rows[:2] + [rows[3]] + rows[11:], f"{tmp_path}/log")
    df = U.tail(stream(spark, f"{tmp_path}/log"), idle_ms=1500)
    query = S.fan_out(df, {"out": f"{tmp_path}/out"}, f"{tmp_path}/state", "append").trigger(processingTime="300 milliseconds").start()
    read = lambda: [(r["seq"], r["event"]) for r in spark.read.schema(with_batch(df)).parquet(f"{tmp_path}/out").where("job_id = 1").orderBy("batch", "seq").collect()]
    seen = lambda: spark.read.schema(with_batch(df)).parquet(f"{tmp_path}/out").where("job_id = 2").collect()
    end = time.time() + 60
    try:
        while time.time() < end and not any((tmp_path / "out").glob("*/_SUCCESS")):
            time.sleep(0.5)
        while time.time() < end and (len(read()) < 4 or (None, U.PING) not in read()):
            time.sleep(0.5)
        before = read()
        put(spark, [rows[2], *rows[4:11]], f"{tmp_path}/log")
        while time.time() < end and (10, "job_completed") not in read():
            time.sleep(0.5)
    finally:
        query.stop()
    assert [s for s, _ in before if s is not None] == [0, 1, 3]  # 3 waited for 2, and came out when nothing came
    assert (None, U.PING) in before
    assert sorted(s for s, _ in read() if s is not None) == list(range(11))  # 2 came all the same, and each once
    assert len(seen()) == 11  # a job that has ended gets no ping


def test_an_owner_gets_history_then_what_comes(spark, tmp_path):
    """Oldest job first; then live events, repeated ones once, from jobs that end and jobs that begin; other owners apart."""
    old, young, new = job(7, 9, start=0), job(7, 5, start=100), job(7, 6, start=500)
    steps = [(young[:6], []), (old + job(8, 1)[:3], []), ([], [(7, NONE)]), (young[4:], []), (new[:4] + young[10:], []), (new[3:], [(7, NONE)])]
    got = []
    for rows, connects in steps:
        put(spark, rows, f"{tmp_path}/log")
        put(spark, connects, f"{tmp_path}/connections", "owner_id long, ts timestamp")
        got = run(U.owner_tail(stream(spark, f"{tmp_path}/log"), stream(spark, f"{tmp_path}/connections", "owner_id long, ts timestamp")), tmp_path)
    got = sorted(got, key=lambda r: r["place"])
    wanted = [(9, k) for k in range(11)] + [(5, k) for k in range(11)] + [(6, k) for k in range(11)]
    assert [(r["job_id"], r["seq"]) for r in got] == wanted
    assert [r["place"] for r in got] == list(range(1, 34)) and {r["owner_id"] for r in got} == {7}
    assert [r["live"] for r in got] == [False] * 17 + [True] * 16


def test_a_late_event_reaches_an_owner(spark, tmp_path):
    rows = job(7, 1)
    got = []
    for own, connects in (([rows[0], rows[2]], [(7, NONE)]), ([rows[4], rows[1]], []), ([rows[3], rows[1]], [])):
        put(spark, own, f"{tmp_path}/log")
        put(spark, connects, f"{tmp_path}/connections", "owner_id long, ts timestamp")
        got = run(U.owner_tail(stream(spark, f"{tmp_path}/log"), stream(spark, f"{tmp_path}/connections", "owner_id long, ts timestamp")), tmp_path)
    assert [r["seq"] for r in sorted(got, key=lambda r: r["place"])] == [0, 2, 1, 4, 3]


def test_deletion_of_queued_running_and_ended_jobs(spark, tmp_path):
    """A tombstone between batches: events before it passed, none after; at the end what is left is the batch anti-join."""
    one, two, three, four = job(1, 1), job(1, 2, start=9), job(1, 3, start=20), job(2, 4, start=30)
    gone = [(1, 1), (1, 2), (1, 3), (None, 4), (9, 4)]
    steps = [(one[:5] + three, []), ([], gone), (one[5:] + two, []), (one[8:] + four, [(1, 1)])]
    got = []
    for rows, deleted in steps:
        put(spark, rows, f"{tmp_path}/log")
        put(spark, deleted, f"{tmp_path}/gone", "owner_id long, job_id long")
        got = run(U.undeleted(stream(spark, f"{tmp_path}/log"), stream(spark, f"{tmp_path}/gone", "owner_id long, job_id long"), None), tmp_path)
    closed = {(r["owner_id"], r["job_id"]): r["was"] for r in got if r["event"] == U.DELETED}
    assert closed == {(1, 1): "running", (1, 2): "queued", (1, 3): "ended", (9, 4): "queued"}
    assert sum(r["event"] == U.DELETED for r in got) == 4
    passed = [(r["job_id"], r["seq"]) for r in got if r["event"] != U.DELETED]
    assert sorted(passed) == [(1, k) for k in range(5)] + [(3, k) for k in range(11)] + [(4, k) for k in range(11)]
    left = sorted(p for p in passed if (1, p[0]) not in closed)
    every = spark.createDataFrame(one + two + three + four, SCHEMA)
    tombs = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "owner_id long, job_id long")
    assert left == sorted((r["job_id"], r["seq"]) for r in S.undeleted(every, tombs).collect())


@pytest.mark.parametrize("step", [1, 7])
def test_frames_however_bytes_are_cut(spark, tmp_path, step):
    """The same frames from pieces of any length over four batches, the pieces in any order; the rest is one frame at most."""
    text = "".join(f": note\nevent: stage_started\ndata: {{\"job_id\":{i},\ndata: \"x\":\"é\"}}\n\n" for i in range(6)) + ": ping\n\nevent: job_completed\ndata: {}\n\nevent: half"
    pieces = [text[i : i + step] for i in range(0, len(text), step)]
    chunks = [(k, i, p) for k in (1, 2) for i, p in enumerate(pieces)]
    got = []
    for part in range(4):
        put(spark, [c for c in chunks if (c[1] * 3 + c[0]) % 4 == part], f"{tmp_path}/log", "stream_id long, seq long, chunk string")
        got = run(U.frames(stream(spark, f"{tmp_path}/log", "stream_id long, seq long, chunk string")), tmp_path)
    wanted = [(k, i, raw) for k in (1, 2) for i, raw in enumerate(text.split("\n\n")[:-1])]
    assert sorted((r["stream_id"], r["frame_idx"], r["raw"]) for r in got) == wanted
    parsed = jobs.parsed_raw(spark.createDataFrame(wanted, U.RAW)).collect()
    whole = jobs.parsed_frames(spark.createDataFrame(chunks, "stream_id long, seq long, chunk string")).where("event <> 'half'").collect()
    assert sorted(map(tuple, parsed)) == sorted(map(tuple, whole)) and len(parsed) == 14


def test_places_hold_release_and_dedupe():
    p = U.Places()
    assert p.come(0, "a") == [(0, "a")] and p.come(2, "c") == [] and p.come(2, "c") == []
    p = U.Places(p.saved())
    assert p.release() == [(2, "c")] and p.release() == []
    assert p.come(1, "b") == [(1, "b")] and p.come(1, "b") == [] and p.come(3, "d") == [(3, "d")]
    assert p.saved() == [4, [], []]
