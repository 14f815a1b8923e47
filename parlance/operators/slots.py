"""Jobs in a bounded number of slots: each one a Spark job group in the scheduler pool of its slot, deleted by its group."""

from __future__ import annotations

import threading
from concurrent.futures import Future, ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from parlance.sources import folders


@dataclass
class Job:
    """A job's state: queued, running, completed or failed; where its rows go; the group of its Spark jobs."""

    rows: DataFrame
    path: str
    group: str
    status: str = "queued"
    error: str | None = None
    deleted: bool = False
    future: Future | None = None


class Slots:
    """Jobs of which at most `most` run at a time; the others wait in the order they came.

    A job writes its rows to a folder of its own. Spark runs its tasks in the pool slot_<n>, so that with
    spark.scheduler.mode=FAIR the running jobs share the cluster evenly. One that fails keeps its error and frees its slot."""

    def __init__(self, spark: SparkSession, most: int):
        self._spark, self._lock, self._jobs = spark, threading.Lock(), {}
        self._workers = ThreadPoolExecutor(most, thread_name_prefix="slot")

    def submit(self, job_id: str, rows: DataFrame) -> Job:
        path = folders.new(self._spark, "job")
        job = Job(rows, path, path.rsplit("/", 1)[-1])
        with self._lock:
            if job_id in self._jobs:
                raise ValueError(f"job {job_id} is there already")
            self._jobs[job_id] = job
        job.future = self._workers.submit(inheritable_thread_target(self._spark)(self._run), job)
        return job

    def delete(self, job_id: str) -> bool:
        """Forget a job: a queued one never starts; a running one's group is cancelled, and its slot deletes what it wrote
        once it has stopped; a finished one's rows go at once. False if there is none."""
        with self._lock:
            job = self._jobs.pop(job_id, None)
            if job is None:
                return False
            job.deleted, status = True, job.status
        job.future.cancel()
        if status == "running":
            self._spark.sparkContext.cancelJobGroup(job.group)
        elif status != "queued":
            folders.delete(self._spark, job.path)
        return True

    def finish(self) -> dict[str, str]:
        """Wait for all jobs, take no more, and give the state of each that was not deleted."""
        self._workers.shutdown(wait=True)
        return {job_id: job.status for job_id, job in self._jobs.items()}

    def result(self, job_id: str) -> DataFrame:
        """A job's rows, once it has ended; its error if it failed, KeyError if it was deleted."""
        job = self._jobs[job_id]
        wait([job.future])
        if job.status != "completed":
            raise RuntimeError(f"job {job_id} {job.status}: {job.error}")
        return self._spark.read.schema(job.rows.schema).parquet(job.path)

    def _run(self, job: Job) -> None:
        with self._lock:
            if job.deleted:
                return
            job.status = "running"
        context = self._spark.sparkContext
        context.setLocalProperty("spark.scheduler.pool", threading.current_thread().name)
        context.setJobGroup(job.group, "a job in a slot")
        status, error = "completed", None
        try:
            job.rows.write.parquet(job.path)
        except Exception as e:
            status, error = "failed", str(e)
        with self._lock:
            job.status, job.error = status, error
        if job.deleted:
            folders.delete(self._spark, job.path)
