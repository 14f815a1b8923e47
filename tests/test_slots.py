"""Jobs in slots: never more job groups at work than slots, deletion of waiting, running and finished jobs, failures."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parlance.operators.slots import Slots


def slow(spark, seconds, value=1):
    def wait(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    return spark.range(2, numPartitions=2).mapInPandas(wait, "id long").withColumn("value", F.lit(value))


def until(true, seconds=30):
    end = time.time() + seconds
    while not true():
        assert time.time() < end
        time.sleep(0.02)


def at_work(spark, jobs):
    """Groups of which Spark runs a job just now."""
    tracker = spark.sparkContext.statusTracker()
    active = set(tracker.getActiveJobsIds())
    return [j.group for j in jobs if active & set(tracker.getJobIdsForGroup(j.group))]


def test_no_more_groups_at_work_than_slots(spark):
    slots = Slots(spark, 2)
    jobs = [slots.submit(f"job {k}", slow(spark, 0.7, k)) for k in range(5)]
    seen = []
    while not all(j.future.done() for j in jobs):
        seen.append(len(at_work(spark, jobs)))
        time.sleep(0.02)
    assert max(seen) == 2
    assert slots.finish() == {f"job {k}": "completed" for k in range(5)}
    assert [slots.result(f"job {k}").select("value").distinct().collect()[0][0] for k in range(5)] == list(range(5))


def test_a_waiting_job_that_is_deleted_never_starts(spark):
    slots = Slots(spark, 1)
    slots.submit("first", slow(spark, 0.7))
    waiting = slots.submit("second", slow(spark, 0.1))
    slots.submit("third", slow(spark, 0.1, 3))
    assert slots.delete("second") and not slots.delete("second") and not slots.delete("other")
    assert slots.finish() == {"first": "completed", "third": "completed"}
    assert waiting.status == "queued" and waiting.future.cancelled()
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(waiting.group)) == []
    assert not Path(waiting.path.removeprefix("file://")).exists()
    with pytest.raises(KeyError):
        slots.result("second")


def test_a_running_job_that_is_deleted_stops_and_leaves_nothing(spark):
    slots = Slots(spark, 1)
    running = slots.submit("long", slow(spark, 60))
    after = slots.submit("next", slow(spark, 0.1))
    until(lambda: at_work(spark, [running]))
    began = time.time()
    assert slots.delete("long")
    assert slots.finish() == {"next": "completed"}
    assert time.time() - began < 50 and after.status == "completed" and slots.result("next").count() == 2
    assert running.status == "failed" and not Path(running.path.removeprefix("file://")).exists()


def test_a_finished_job_that_is_deleted_loses_its_rows(spark):
    slots = Slots(spark, 1)
    done = slots.submit("done", spark.range(3))
    assert slots.result("done").count() == 3 and Path(done.path.removeprefix("file://")).exists()
    assert slots.delete("done") and slots.finish() == {}
    assert not Path(done.path.removeprefix("file://")).exists()


def test_a_failure_frees_its_slot(spark):
    slots = Slots(spark, 1)
    slots.submit("bad", spark.range(1).select(F.raise_error(F.lit("no such recording")).cast("string").alias("x")))
    slots.submit("good", spark.range(3))
    with pytest.raises(ValueError):
        slots.submit("good", spark.range(3))
    assert slots.finish() == {"bad": "failed", "good": "completed"}
    with pytest.raises(RuntimeError, match="no such recording"):
        slots.result("bad")
    assert slots.result("good").count() == 3
