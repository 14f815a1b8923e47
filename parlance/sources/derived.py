"""Transcript-shaped tables derived from the test tables: what recognisers and diarizers would deliver for many files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, word_idx, turn, role, word, start_s, end_s): the words of a conversation, half a second apart. Every fourth
    file has no sentence marks; of these some begin with a word at which a stand-in model is away or fails."""
    pieces = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("file_id"), "turn", "role", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "word")
    )
    idx = (F.row_number().over(Window.partitionBy("file_id").orderBy("turn", "pos")) - 1).cast("long")
    bare = F.coalesce(F.nullif(F.regexp_replace("word", "[.!?؟۔…]", ""), F.lit("")), F.lit("mm"))
    first = F.when(F.col("file_id") % 8 == 5, "(unreadable)").when(F.col("file_id") % 16 == 1, "(absent)").otherwise(bare)
    word = F.when(F.col("file_id") % 4 != 1, F.col("word")).when(F.col("word_idx") == 0, first).otherwise(bare)
    numbered = pieces.select("file_id", idx.alias("word_idx"), "turn", "role", "word").withColumn("word", word)
    return numbered.withColumn("start_s", F.col("word_idx") * 0.5).withColumn("end_s", F.col("word_idx") * 0.5 + 0.25)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, seg_idx, start_s, end_s, text, no_speech_prob): six words each, across turns."""
    return segments_of(words(spark, sf_dir))


def segments_of(words: DataFrame) -> DataFrame:
    w = words.withColumn("seg_idx", F.floor(F.col("word_idx") / 6))
    made = w.groupBy("file_id", "seg_idx").agg(
        F.min("start_s").alias("start_s"), (F.max("end_s") + 0.25).alias("end_s"), in_order("word", "word_idx").alias("text")
    )
    return made.withColumn("no_speech_prob", ((F.col("file_id") * 31 + F.col("seg_idx") * 7) % 11) / F.lit(10.0))


def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, seg_idx, start_s, end_s, speaker, text): six words each, never across turns; the role speaks."""
    w = words(spark, sf_dir)
    pos = F.row_number().over(Window.partitionBy("file_id", "turn").orderBy("word_idx")) - 1
    cut = w.withColumn("part", F.floor(pos / 6)).groupBy("file_id", "turn", "part", F.col("role").alias("speaker"))
    made = cut.agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), in_order("word", "word_idx").alias("text"))
    idx = (F.row_number().over(Window.partitionBy("file_id").orderBy("turn", "part")) - 1).cast("long")
    return made.select("file_id", idx.alias("seg_idx"), "start_s", "end_s", "speaker", "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, turn_idx, start_s, end_s, speaker): raw labels, shifted by 0.75 s, every fifth turn missing."""
    return turns_of(words(spark, sf_dir))


def turns_of(words: DataFrame) -> DataFrame:
    label = F.when(F.col("role") == "system", "SPEAKER_07").when(F.col("role") == "user", "SPEAKER_02").otherwise("SPEAKER_00")
    some = words.where(F.col("turn") % 5 != 3).groupBy("file_id", F.col("turn").alias("turn_idx"), "role")
    span = some.agg((F.min("start_s") + 0.75).alias("start_s"), (F.max("end_s") + 0.75).alias("end_s"))
    return span.select("file_id", "turn_idx", "start_s", "end_s", label.alias("speaker"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner_id, job_id, seq, ts, event, stage_index, progress): eleven events a job, the last one terminal."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = table(spark, sf_dir, "events").withColumn("n", n).withColumn("seq", (F.col("n") % 11).cast("long"))
    stage = F.floor(F.col("seq") / 2)
    end = F.col("seq") == 10
    name = F.when(end & (F.col("event_type") == "error"), "job_failed").when(end, "job_completed")
    name = name.when(F.col("seq") % 2 == 0, "stage_started").otherwise("stage_completed")
    return e.select(
        F.col("user_id").alias("owner_id"),
        (F.col("user_id") * 100 + F.floor(F.col("n") / 11)).cast("long").alias("job_id"),
        "seq", "ts", name.alias("event"),
        F.when(~end, stage).alias("stage_index"),
        F.when(~end, (stage + F.col("seq") % 2) / F.lit(5.0)).alias("progress"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner_id, job_id, created_at, file_name, status, has_error): the list of jobs as a snapshot of their first events."""
    e = job_events(spark, sf_dir)
    made = e.groupBy("owner_id", "job_id").agg(F.min("ts").alias("created_at"))
    kinds = F.array(*map(F.lit, ("queued", "running", "completed", "failed", "interrupted", "cancelled")))
    name = F.concat(F.lit("clip_"), (F.col("job_id") % 7).cast("string"), F.lit(".wav"))
    return made.select("owner_id", "job_id", "created_at", name.alias("file_name"), F.element_at(kinds, (F.col("job_id") % 6 + 1).cast("int")).alias("status"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, kind, raw): model replies in six shapes: clean, in prose, malformed, garbage, odd confidence, upper case."""
    kind = F.col("doc_id") % 6
    flag = F.when(F.col("toxic") == 1, "true").otherwise("false")
    body = lambda cat, conf: F.concat(F.lit('{"hate_speech": '), flag, F.lit(f', "category": "{cat}", "confidence": "{conf}", "reason": "r'), F.col("doc_id").cast("string"), F.lit('"}'))
    raw = (
        F.when(kind == 0, body("insult", "high")).when(kind == 1, F.concat(F.lit("Answer: "), body("threat", "medium"), F.lit(" end.")))
        .when(kind == 2, F.lit('Answer: {"hate_speech": tru')).when(kind == 3, F.lit("no idea"))
        .when(kind == 4, body("insult", "certain")).otherwise(body("INSULT", "HIGH"))
    )
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id"), kind.alias("kind"), raw.alias("raw"))


def entity_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, pos, text, label, score): capitalised words of documents as entities."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", r"\s+")).alias("pos", "text"))
    some = d.where(F.col("text").rlike("^[A-Z][a-z]+$"))
    labels = F.array(*map(F.lit, ("person", "place", "org", "date", "event", "work", "law", "group", "other")))
    return some.select("file_id", F.col("pos").cast("long").alias("pos"), "text", F.element_at(labels, F.length("text") % 9 + 1).alias("label"), (F.col("pos") % 10 / F.lit(10.0)).alias("score"))


def in_order(value: str, by: str, between: str = " "):
    """The values of a group joined in the order of another column."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(by).alias("i"), F.col(value).alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), between)
