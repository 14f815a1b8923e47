"""Streams over several micro-batches, with late and repeated events, against the batch fold and plain lists."""

import random

from parlance.operators import jobs
from parlance.streaming import events as S

SCHEMA = "owner_id long, job_id long, seq long, ts timestamp, event string, stage_index long, progress double"


def logged(spark, at, batches):
    """Each batch appended to the log as a file of its own."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(at)
    return S.read(spark, at, spark.read.parquet(at).schema, files_a_batch=1)


def job(owner, number, end="job_completed", start=0):
    import datetime

    at = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=start + k)
    rows = [(owner, number, k, at(k), "stage_started" if k % 2 == 0 else "stage_completed", k // 2, (k // 2 + k % 2) / 5) for k in range(10)]
    return rows + ([(owner, number, 10, at(10), end, None, None)] if end else [])


def run(stream, sinks, at, mode="update"):
    S.fan_out(stream, sinks, f"{at}/state", mode).trigger(availableNow=True).start().awaitTermination()


def test_late_and_repeated_events_fold_like_the_batch(spark, tmp_path):
    rows = job(1, 1) + job(1, 2, "job_failed", 5) + job(2, 3, None) + job(2, 4, "job_cancelled", 9)
    r = random.Random(1)
    mixed = rows + r.sample(rows, 12)
    r.shuffle(mixed)  # so later batches bring earlier events
    batches = [mixed[i : i + 15] for i in range(0, len(mixed), 15)]
    run(S.progress(logged(spark, f"{tmp_path}/log", batches)), {"all": f"{tmp_path}/all", "terminal": f"{tmp_path}/terminal"}, tmp_path)
    assert len({x["batch"] for x in spark.read.parquet(f"{tmp_path}/all").select("batch").collect()}) == len(batches)
    last = {}
    for x in spark.read.parquet(f"{tmp_path}/all").orderBy("batch").collect():
        last[x["job_id"]] = (x["status"], x["stage_index"], x["stage"], x["progress"])
    wanted = {x["job_id"]: (x["status"], x["stage_index"], x["stage"], x["progress"]) for x in jobs.fold(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert last == wanted
    assert sorted(x["job_id"] for x in spark.read.parquet(f"{tmp_path}/terminal").collect()) == [1, 2, 4]


def test_an_owner_gets_the_oldest_job_first_and_no_other_owners(spark):
    rows = job(7, 5, start=100) + job(7, 9, start=0) + job(8, 1)
    got = S.replay(spark.createDataFrame(rows, SCHEMA)).where("owner_id = 7").orderBy("place").collect()
    assert [(x["job_id"], x["seq"]) for x in got] == [(9, k) for k in range(11)] + [(5, k) for k in range(11)]
