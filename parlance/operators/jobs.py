"""Job lists, live overlays and progress: the queries behind the views of running work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from parlance.sources.folders import keep

EVENTS = ("stage_started", "stage_completed", "job_completed", "job_failed", "job_cancelled")
#: Labels of the five stages.
STAGES = ("Transcribing", "Translating", "Running word-level analysis", "Summarizing", "Detecting hate speech")


def stage_label(index: Column) -> Column:
    return F.get(F.array(*map(F.lit, STAGES)), index.cast("int"))


def fold(events: DataFrame) -> DataFrame:
    """(job_id, status, stage_index, stage, progress): a job's events in order of seq folded to its state.

    Index and progress only grow; a terminal event decides the status, the last one if there are several; completion
    means progress 1 and no stage. Repeated events change nothing."""
    stage = F.col("event").startswith("stage_")
    done = F.when(F.col("event") == "job_completed", "completed").when(F.col("event") == "job_failed", "failed").when(F.col("event") == "job_cancelled", "cancelled")
    e = events.where(F.col("event").isin(*EVENTS)).withColumn("done", done)
    shown = F.when(stage, stage_label(F.col("stage_index")))
    made = e.groupBy("owner_id", "job_id").agg(
        F.max_by("done", F.when(F.col("done").isNotNull(), F.col("seq"))).alias("end"),
        F.coalesce(F.max(F.when(stage, F.col("stage_index"))), F.lit(0).cast("long")).alias("stage_index"),
        F.max_by(F.struct(F.when(F.col("event") != "job_completed", shown).alias("stage")), F.when(stage | (F.col("event") == "job_completed"), F.col("seq"))).alias("last"),
        F.max(F.when(F.col("event") == "job_completed", F.lit(1.0)).when(stage, F.col("progress")).otherwise(F.lit(0.0))).alias("progress"),
    )
    return made.select("owner_id", "job_id", F.coalesce("end", F.lit("running")).alias("status"), "stage_index", F.col("last.stage").alias("stage"), "progress")


def overlaid(jobs: DataFrame, live: DataFrame) -> DataFrame:
    """jobs with the live status where there is one; live rows without a job are left out."""
    l = live.select("job_id", F.col("status").alias("live_status"), F.col("stage").alias("live_stage"), F.col("progress").alias("live_progress"))
    return jobs.join(l, "job_id", "left").withColumn("status", F.coalesce("live_status", "status"))


def counts(jobs: DataFrame) -> DataFrame:
    """Jobs of an owner by bucket; whatever is neither running, queued nor completed counts as failed."""
    s = F.col("status")
    return jobs.groupBy("owner_id").agg(
        F.count_if(s == "running").alias("processing"), F.count_if(s == "queued").alias("queued"), F.count_if(s == "completed").alias("finished"),
        F.count_if(~F.coalesce(s.isin("running", "queued", "completed"), F.lit(False))).alias("failed"), F.count("*").alias("total"),
    )


def batch_progress(counted: DataFrame) -> DataFrame:
    """Per cent of an owner's jobs that ended, rounded half up."""
    return counted.withColumn("percent", F.floor(100 * (F.col("finished") + F.col("failed")) / F.col("total") + 0.5).cast("long"))


def running_first(jobs: DataFrame) -> DataFrame:
    """Of each owner the first running job in list order (newest first), with its live detail."""
    order = F.struct(-F.unix_micros(F.col("created_at").cast("timestamp")), F.col("job_id"))
    detail = F.struct("job_id", "file_name", F.col("live_stage").alias("stage"), F.coalesce("live_progress", F.lit(0.0)).alias("progress"))
    return jobs.where("status = 'running'").groupBy("owner_id").agg(F.min_by(detail, order).alias("first")).select("owner_id", "first.*")


def seeded(status: Column, error: Column) -> tuple[Column, Column]:
    """Status and error to show before any live event."""
    shown = F.when(status.isin("running", "completed", "failed", "cancelled"), status).when(status == "interrupted", "failed").otherwise("queued")
    text = F.when(status == "interrupted", F.coalesce(error, F.lit("interrupted"))).when(status.isin("running", "completed", "failed", "cancelled"), error)
    return shown, text


def frame(event: Column, payload: Column) -> Column:
    """A server-sent event frame."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), payload, F.lit("\n\n"))


def parsed_frames(chunks: DataFrame, by: str = "seq") -> DataFrame:
    """(stream_id, frame_idx, event, data) from text chunks (stream_id, seq, chunk) cut anywhere: comments are skipped,
    several data lines are joined by line breaks, frames without event or data are dropped."""
    whole = chunks.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "chunk"))), lambda p: p["chunk"]), "").alias("t"))
    return parsed_raw(whole.select("stream_id", F.posexplode(F.split("t", "\n\n")).alias("frame_idx", "raw")))


def parsed_raw(frames: DataFrame) -> DataFrame:
    """(stream_id, frame_idx, event, data) of whole frames (stream_id, frame_idx, raw), also of a stream of them."""
    lines = F.split("raw", "\n")
    pick = lambda key: F.transform(F.filter(lines, lambda x: x.startswith(key + ":")), lambda x: F.trim(F.substr(x, F.lit(len(key) + 2))))
    made = frames.select("stream_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.try_element_at(pick("event"), F.lit(-1)).alias("event"), pick("data").alias("lines"))
    return made.where((F.coalesce("event", F.lit("")) != "") & (F.size("lines") > 0)).select("stream_id", "frame_idx", "event", F.array_join("lines", "\n").alias("data"))


def known_events(frames: DataFrame) -> DataFrame:
    """Frames of the five known events whose data is a JSON object."""
    return frames.where(F.col("event").isin(*EVENTS) & F.coalesce(F.schema_of_variant(F.try_parse_json("data")).startswith("OBJECT"), F.lit(False)))


def occurrence(rows: DataFrame, part: list[str], by: list[str]) -> DataFrame:
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*part).orderBy(*by)).cast("long"))


def folders(jobs: DataFrame, part: list[str], by: list[str], stem: str = "stem") -> DataFrame:
    """jobs with folder: the stem, then stem_2, stem_3 for later ones of the same stem."""
    base = jobs.withColumn(stem, F.coalesce(F.nullif(F.col(stem), F.lit("")), F.lit("result")))
    n = F.col("occurrence")
    return occurrence(base, [*part, stem], by).withColumn("folder", F.when(n == 1, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit("_"), n.cast("string"))))


def observed(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """df, kept, and figures of it that were gathered while it was written, without a pass of their own."""
    seen = Observation()
    kept = keep(df.observe(seen, *(F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in figures.items())))
    return kept, seen.get
