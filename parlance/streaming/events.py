"""Job events as a stream: parsing, filtering, and progress as keyed state that replays change nothing in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.jobs import EVENTS, STAGES
from parlance.streaming.keyed import stateful

PROGRESS = "owner_id long, job_id long, status string, stage_index long, stage string, progress double, seq long, ends boolean"
#: What a subscriber of a job gets.
FRAMES = "owner_id long, job_id long, seq long, event string, stage_index long, closes boolean"


def known(events: DataFrame) -> DataFrame:
    """Events of the five known names, whose owner and job are set."""
    return events.where(F.col("event").isin(*EVENTS) & F.col("job_id").isNotNull() & F.col("owner_id").isNotNull())


def of_owner(events: DataFrame, owner: int) -> DataFrame:
    """One owner's events of all jobs; a filter on the source column, so files of other owners are pruned."""
    return events.where(F.col("owner_id") == owner)


def undeleted(events: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Events of jobs that are not deleted."""
    return events.join(tombstones.select("job_id").distinct(), "job_id", "left_anti")


def advance(state: tuple, rows: list[tuple]) -> tuple:
    """Fold rows (seq, event, stage_index, progress), in any order and however often they come, into (status, stage_index,
    stage, progress, seq, ended, shown): ended and shown are the seq of the terminal event and of the label that count, so that
    late events change neither."""
    status, index, stage, progress, last, ended, shown = state
    staged, done, terminal = (-1, None), (-1, None), (-1, None)  # the newest of each kind
    for seq, event, at, share in rows:
        last = max(last, seq)
        if event in ("stage_started", "stage_completed"):
            if at == at:  # not null
                index = max(index, int(at))
            if share == share:
                progress = max(progress, share)
            if ended < 0:
                status = "running"
            if seq > staged[0]:
                staged = seq, STAGES[int(at)]
            continue
        if event == "job_completed":
            progress = 1.0
            if seq > done[0]:
                done = seq, None
        if seq > terminal[0]:
            terminal = seq, event
    seq, label = staged if staged[0] >= done[0] else done
    if seq >= max(shown, 0):
        shown, stage = seq, label
    if terminal[0] >= max(ended, 0):
        ended, status = terminal[0], {"job_completed": "completed", "job_failed": "failed"}.get(terminal[1], "cancelled")
    return status, index, stage, progress, last, ended, shown


def _progress(key: tuple, now: list | None, rows: list[tuple]) -> tuple[tuple, list[tuple], None]:
    before = tuple(now) if now else ("queued", 0, None, 0.0, -1, -1, -1)
    after = advance(before, rows)
    return after, [(*key, *after[:5], after[5] >= 0 and before[5] < 0)], None


def replay(history: DataFrame) -> DataFrame:
    """history (a job's first ts tells its age) with place: where an event comes when an owner connects, the jobs one after
    the other, the oldest first. An owner's places are numbered in one task, as one connection gets them."""
    created = F.min("ts").over(Window.partitionBy("job_id"))
    order = Window.partitionBy("owner_id").orderBy("created", "job_id", "seq")
    return known(history).withColumn("created", created).withColumn("place", F.row_number().over(order).cast("long")).drop("created")


def progress(events: DataFrame) -> DataFrame:
    """A stream of each job's state after every batch that has events of it (update mode); ends marks the one in which the job
    ended."""
    e = known(events).select("owner_id", "job_id", "seq", "event", "stage_index", "progress")
    return stateful(e, ["owner_id", "job_id"], _progress, PROGRESS, "update")


def read(spark, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    """An event log of Parquet files as a stream, oldest files first: history, then what is appended."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def fan_out(stream: DataFrame, sinks: dict[str, str], checkpoint: str, mode: str = "update"):
    """Each batch to several Parquet sinks, one a name: all rows, or for `terminal` only those in which a job ended. A batch
    that is run again overwrites its own folder, so every row appears once."""

    def write(batch: DataFrame, number: int) -> None:
        several = len(sinks) > 1  # what goes to one sink only need not be held
        if several:
            batch.persist()
        for name, path in sinks.items():
            some = batch.where("ends") if name == "terminal" else batch
            some.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if several:
            batch.unpersist()

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)


def first_terminal(events: DataFrame) -> DataFrame:
    """One terminal event a job, whatever arrives again within the watermark."""
    ended = known(events).where(~F.col("event").startswith("stage_")).withColumn("ts", F.col("ts").cast("timestamp"))
    return ended.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["job_id"])
