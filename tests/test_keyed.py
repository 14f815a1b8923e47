"""Streams with many more keys than calls of their state functions: what comes out is as if each key were alone."""

import random

from parlance.operators import jobs
from parlance.streaming import events as S
from parlance.streaming import keyed
from parlance.streaming import subscriptions as U
from tests.test_streams import SCHEMA, job
from tests.test_subscriptions import put, stream

JOBS = 3 * keyed.GROUPS


def many(seed):
    """Events of many jobs, some of them without an end, in three parts that overlap and are in no order."""
    ends = ("job_completed", "job_failed", "job_cancelled", None)
    rows = [e for k in range(JOBS) for e in job(k % 50, 1000 * (k % 50) + k, ends[k % 4], k)]
    r = random.Random(5)
    parts = [[], [], []]
    for e in rows:
        for n in {r.randrange(3), r.randrange(3)}:
            parts[n].append(e)
    return rows, parts


def run(df, at, sinks, mode):
    """One run of the stream from its checkpoint; the rows of its state."""
    query = S.fan_out(df, {k: f"{at}/{k}" for k in sinks}, f"{at}/state", mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return max(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators)


def test_progress_of_many_jobs_takes_few_calls(spark, tmp_path):
    rows, parts = many(5)
    for part in parts:
        put(spark, part, f"{tmp_path}/log")
        assert run(S.progress(stream(spark, f"{tmp_path}/log")), tmp_path, ["all"], "update") <= keyed.GROUPS
    last = {}
    for x in spark.read.parquet(f"{tmp_path}/all").orderBy("batch").collect():
        last[x["owner_id"], x["job_id"]] = (x["status"], x["stage_index"], x["stage"], x["progress"])
    folded = jobs.fold(spark.createDataFrame(rows, SCHEMA)).collect()
    assert last == {(x["owner_id"], x["job_id"]): (x["status"], x["stage_index"], x["stage"], x["progress"]) for x in folded}
    assert len(last) == JOBS


def test_a_fan_out_of_many_jobs_takes_few_calls(spark, tmp_path):
    """Each job that ended is once in the sink of terminal states, whatever batch ended it and whatever comes again."""
    rows, parts = many(8)
    for part in [*parts, parts[0]]:
        put(spark, part, f"{tmp_path}/log")
        assert run(S.progress(stream(spark, f"{tmp_path}/log")), tmp_path, ["all", "terminal"], "update") <= keyed.GROUPS
    ended = {(owner, number): event for owner, number, _, _, event, *_ in rows if not event.startswith("stage_")}
    got = [(x["owner_id"], x["job_id"], x["status"]) for x in spark.read.parquet(f"{tmp_path}/terminal").collect()]
    assert sorted(got) == sorted((*key, event.removeprefix("job_")) for key, event in ended.items())


def test_subscribers_of_many_jobs_take_few_calls(spark, tmp_path):
    """Each job's events in order and once, up to its end, whatever other jobs share its calls."""
    rows, parts = many(6)
    for part in parts:
        put(spark, part, f"{tmp_path}/log")
        assert run(U.tail(stream(spark, f"{tmp_path}/log"), None), tmp_path, ["out"], "append") <= keyed.GROUPS
    got = {}
    for x in spark.read.parquet(f"{tmp_path}/out").orderBy("batch", "seq").collect():
        got.setdefault((x["owner_id"], x["job_id"]), []).append((x["seq"], x["event"], x["stage_index"], x["closes"]))
    wanted = {}
    for owner, number, seq, _, event, stage, _ in rows:
        wanted.setdefault((owner, number), []).append((seq, event, stage, seq == 10))
    assert got == wanted


def test_deletion_among_many_jobs_takes_few_calls(spark, tmp_path):
    rows, parts = many(7)
    gone = sorted({(owner, number) for owner, number, *_ in rows if number % 3 == 0})
    seen = set()
    for n, part in enumerate(parts):
        put(spark, part, f"{tmp_path}/log")
        put(spark, gone if n == 1 else [], f"{tmp_path}/gone", "owner_id long, job_id long")
        df = U.undeleted(stream(spark, f"{tmp_path}/log"), stream(spark, f"{tmp_path}/gone", "owner_id long, job_id long"), None)
        assert run(df, tmp_path, ["out"], "append") <= keyed.GROUPS
        seen |= {e[:3] for e in part if n == 0 or (e[0], e[1]) not in set(gone)}
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(x["owner_id"], x["job_id"], x["seq"]) for x in out if x["event"] != U.DELETED} == seen
    closed = [x for x in out if x["event"] == U.DELETED]
    first = {}
    for owner, number, seq, *_ in parts[0] + parts[1]:
        first.setdefault((owner, number), set()).add(seq)
    was = lambda key: "queued" if key not in first else "ended" if 10 in first[key] else "running"
    assert sorted((x["owner_id"], x["job_id"], x["was"]) for x in closed) == [(*key, was(key)) for key in gone]
