"""Queries on words, turns, segments and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as X
from parlance.operators import scorers, sentences, speakers
from parlance.operators.jobs import STAGES
from parlance.plans.oracle import summary_tables, with_tables
from parlance.sources import derived as D
from parlance.sources.folders import keep

DENSE = "'[.!?؟۔…]'"


def recordings(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, words and turns, each derived once and kept."""
    words = keep(D.words(spark, sf))
    return keep(D.segments_of(words)), words, keep(D.turns_of(words))


def filled(spark, sf) -> DataFrame:
    segments, words, turns = recordings(spark, sf)
    return speakers.nearest(keep(speakers.split_segments(segments, words, turns)), turns, ["seg_idx", "part"])


def transcript(spark, sf) -> DataFrame:
    """Transcripts of all files: a quarter of them has no marks; of these some meet an outage of the boundary model in one
    window, and some a failure, which sends them the way of the others."""
    return sentences.transcript(*recordings(spark, sf), scorers.unsteady_tenth)


def timed(spark, sf) -> DataFrame:
    """The transcript with clock texts, a translation for files of even number, and whether there is one."""
    t = transcript(spark, sf).withColumn("start", X.clock(F.col("start_s"))).withColumn("end", X.clock(F.col("end_s")))
    even = F.col("file_id") % 2 == 0
    return speakers.shown(t).withColumn("has_translation", even).withColumn("translation", F.when(even, F.translate("text", "aeiou", "AEIOU")))


CLOCK = "CASE WHEN {d} = 0 THEN '' WHEN {d} = 1 THEN '1 day, ' ELSE {d} || ' days, ' END || ({r} // 3600) || ':' || lpad((({r} % 3600) // 60)::VARCHAR, 2, '0') || ':' || lpad(({r} % 60)::VARCHAR, 2, '0')"


def clock_sql(column: str) -> str:
    whole = f"round_even({column}, 0)::BIGINT"
    return CLOCK.format(d=f"({whole} // 86400)", r=f"({whole} % 86400)")


TIMED = f"""SELECT file_id, row_idx, {clock_sql("start_s")} AS start, {clock_sql("end_s")} AS "end", text, n >= 2 AS has_speaker,
  CASE WHEN n >= 2 THEN coalesce(speaker, 'Unknown') END AS speaker, file_id % 2 = 0 AS has_translation, CASE WHEN file_id % 2 = 0 THEN translate(text, 'aeiou', 'AEIOU') END AS translation
FROM transcript JOIN (SELECT file_id, count(DISTINCT speaker) AS n FROM transcript GROUP BY file_id) USING (file_id)"""


def with_timed(sql: str) -> str:
    return with_tables("", "transcript").rstrip() + f",\ntimed AS ({TIMED})\n" + sql


def overlap_words(spark, sf):
    return speakers.by_overlap(D.words(spark, sf), D.turns(spark, sf), ["word_idx"])


def overlap_sums(spark, sf):
    met = speakers.overlapping(D.words(spark, sf).select("file_id", "word_idx", "start_s", "end_s"), D.turns(spark, sf))
    return met.groupBy("file_id", "word_idx", "speaker").agg(F.sum(F.least("end_s", "t_end") - F.greatest("start_s", "t_start")).alias("total"))


def segment_overlap(spark, sf):
    return speakers.labelled(D.segments(spark, sf), D.turns(spark, sf), ["seg_idx"]).select("file_id", "seg_idx", "speaker")


def word_in_segment(spark, sf):
    return speakers.in_segment(D.words(spark, sf), D.segments(spark, sf)).select("file_id", "seg_idx", "word_idx")


def interval_crop(spark, sf):
    speech = D.segments(spark, sf).where("seg_idx % 4 <> 1 and file_id % 5 <> 0")
    return speakers.cropped(D.turns(spark, sf), speech)


def punct(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", X.punctuation_ratio(F.col("text")).alias("ratio"))


PUNCT = rf"""SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE len(regexp_extract_all(text, {DENSE}))::DOUBLE / n END AS ratio FROM (
  SELECT doc_id, text, len(regexp_extract_all(text, '\S+')) AS n FROM documents)"""


def turn_merge(spark, sf):
    return sentences.merged(D.turn_segments(spark, sf), ["seg_idx"])


MERGED = r"""SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY sentence) - 1 AS row_idx, start_s, end_s, speaker, text FROM (
  SELECT file_id, sentence, min(start_s) AS start_s, max(end_s) AS end_s, arg_min(speaker, seg_idx) AS speaker, string_agg(text, ' ' ORDER BY seg_idx) AS text FROM (
    SELECT *, sum(cut) OVER (PARTITION BY file_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) AS sentence FROM (
      SELECT *, CASE WHEN regexp_matches(lag(text) OVER o, '[.!?؟۔]\s*$') OR speaker IS DISTINCT FROM lag(speaker) OVER o THEN 1 ELSE 0 END AS cut
      FROM turn_segments WINDOW o AS (PARTITION BY file_id ORDER BY seg_idx))) GROUP BY file_id, sentence)"""


def runs(spark, sf):
    w = speakers.labelled(D.words(spark, sf), D.turns(spark, sf), ["word_idx"])
    return speakers.run_segments(speakers.runs(w, ["file_id"]), ["file_id"])


RUNS = "SELECT file_id, run_idx::BIGINT AS run_idx, min(start_s) AS start_s, max(end_s) AS end_s, string_agg(word, ' ' ORDER BY word_idx) AS text, max(speaker) AS speaker FROM run_words GROUP BY file_id, run_idx"


def windows(spark, sf):
    return sentences.run_windows(D.words(spark, sf), D.turns(spark, sf))


def window_ends(spark, sf):
    """Boundaries from a rule in place of replies: every tenth word of a window, some codes odd, some repeated."""
    w = windows(spark, sf)
    sizes = w.groupBy("file_id", "run_idx", "window_idx").agg(F.count("*").alias("n"))
    pair = lambda i: F.concat((i * 10 + 9).cast("string"), F.when(i % 3 == 0, ":S").when(i % 3 == 1, ":q").otherwise(":x"))
    reply = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.col("n") / 10).cast("int")), pair), ", ")
    return w, sentences.boundaries(w, sizes.select("file_id", "run_idx", "window_idx", F.concat(reply, F.lit(", 9:E")).alias("reply")))


ENDS = """placed AS (SELECT *, row_number() OVER (PARTITION BY file_id, run_idx ORDER BY word_idx) - 1 AS place, count(*) OVER (PARTITION BY file_id, run_idx) AS total FROM run_words),
ends AS (SELECT *, CASE WHEN place % 400 % 10 = 9 THEN CASE ((place % 400) // 10) % 3 WHEN 0 THEN '.' WHEN 1 THEN '؟' ELSE '.' END
  WHEN place % 400 = 399 OR place = total - 1 THEN '.' END AS mark FROM placed)"""


def with_ends(sql: str) -> str:
    return with_tables("", "run_words").rstrip() + ",\n" + ENDS + "\n" + sql


def boundary_rows(spark, sf):
    return window_ends(spark, sf)[1]


def restored(spark, sf):
    w, ends = window_ends(spark, sf)
    return sentences.restored(w, ends)


RESTORED = with_ends(r"""SELECT file_id, run_idx::BIGINT AS run_idx, sentence::BIGINT AS sentence, start_s, end_s, speaker,
  CASE WHEN regexp_matches(text, '[.!?؟۔]$') THEN text ELSE text || mark END AS text FROM (
  SELECT file_id, run_idx, sentence, min(start_s) AS start_s, max(end_s) AS end_s, max(label) AS speaker, string_agg(word, ' ' ORDER BY place) AS text, max(mark) AS mark FROM (
    SELECT *, max(speaker) OVER (PARTITION BY file_id, run_idx) AS label,
      coalesce(count(mark) OVER (PARTITION BY file_id, run_idx ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM ends)
  GROUP BY file_id, run_idx, sentence)""")


def ml_boundaries(spark, sf):
    """Boundaries from the stand-in model on the numbered word lists."""
    w = windows(spark, sf)
    replies = scorers.scored(sentences.tokens(w), "tokens", scorers.every_tenth)
    return sentences.boundaries(w, replies.select("file_id", "run_idx", "window_idx", "reply"))


def canonical(spark, sf):
    return speakers.canonical(D.turns(spark, sf))


def renumber(spark, sf):
    return speakers.renumbered(filled(spark, sf), ["seg_idx", "part"])


def shown(spark, sf):
    return timed(spark, sf).select("file_id", "row_idx", "has_speaker", "speaker")


def ui_flags(spark, sf):
    t = timed(spark, sf)
    some = lambda c: F.bool_or(F.coalesce(F.col(c) != "", F.lit(False)))
    return t.groupBy("file_id").agg(some("speaker").alias("has_speaker"), some("translation").alias("has_translation"))


def no_speech(spark, sf):
    p = F.when(F.col("seg_idx") % 13 == 0, F.lit(None)).otherwise(F.col("no_speech_prob"))
    return D.segments(spark, sf).withColumn("no_speech_prob", p).where(F.coalesce("no_speech_prob", F.lit(0.0)) <= 0.6)


def speech_guard(spark, sf):
    flag = F.when(F.col("file_id") % 3 == 0, F.lit(True)).when(F.col("file_id") % 3 == 1, F.lit(False))
    files = D.words(spark, sf).select("file_id").distinct().withColumn("speech", flag)
    return files.where(F.coalesce("speech", F.lit(True))).select("file_id")


def asr(spark, sf):
    """Replies as JSON, one a file, taken apart to segments: what is missing reads as null, a missing probability as 0."""
    part = F.struct("seg_idx", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text", "no_speech_prob")
    made = D.segments(spark, sf).groupBy("file_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(part)).alias("segments"))).alias("raw"))
    kind = "struct<segments:array<struct<seg_idx:long,start:double,end:double,text:string,no_speech_prob:double>>>"
    read = made.select("file_id", F.explode(F.from_json("raw", kind)["segments"]).alias("s"))
    return read.select("file_id", "s.seg_idx", F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), F.trim("s.text").alias("text"), F.coalesce("s.no_speech_prob", F.lit(0.0)).alias("no_speech_prob"))


def diarized(spark, sf):
    """Turns as JSON replies, some of them broken: a file whose reply cannot be read has no turns."""
    part = F.struct("turn_idx", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "speaker")
    made = D.turns(spark, sf).groupBy("file_id").agg(F.to_json(F.array_sort(F.collect_list(part))).alias("raw"))
    broken = made.withColumn("raw", F.when(F.col("file_id") % 4 == 0, F.lit("service unavailable")).otherwise(F.col("raw")))
    read = broken.select("file_id", F.explode(F.from_json("raw", "array<struct<turn_idx:long,start:double,end:double,speaker:string>>")).alias("t"))
    return read.select("file_id", "t.turn_idx", F.col("t.start").alias("start_s"), F.col("t.end").alias("end_s"), "t.speaker").where("turn_idx is not null")


def nonempty(spark, sf):
    """Files and whether their transcript has words; files without are skipped with a reason. Every third file is silenced."""
    t = transcript(spark, sf).withColumn("text", F.when(F.col("file_id") % 3 == 0, F.lit("  ")).otherwise(F.col("text")))
    made = t.groupBy("file_id").agg(F.bool_or(~X.is_blank(F.col("text"))).alias("has_words"))
    return made.select("file_id", (~F.col("has_words")).alias("skipped"), F.when(~F.col("has_words"), F.lit("no speech")).alias("skip_reason"))


def file_text(spark, sf):
    return sentences.file_text(D.segments(spark, sf), "seg_idx")


def effective(spark, sf):
    return timed(spark, sf).select("file_id", "row_idx", sentences.effective().alias("text"))


def subsample_rows(spark, sf):
    return sentences.subsampled(D.segments(spark, sf), 20, "seg_idx").select("file_id", "seg_idx")


def distinct_speakers(spark, sf):
    return filled(spark, sf).groupBy("file_id").agg(F.count_distinct(F.nullif(F.col("speaker"), F.lit(""))).alias("speakers"))


def stage_delta(spark, sf):
    """What each stage reports: segments in, rows out, characters, speakers."""
    a = D.segments(spark, sf).groupBy("file_id").agg(F.count("*").alias("segments"))
    b = transcript(spark, sf).groupBy("file_id").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("characters"))
    return a.join(b, "file_id")


def translated(spark, sf):
    t = transcript(spark, sf).withColumn("task", F.when(F.col("file_id") % 4 == 3, "transcribe").otherwise("translate"))
    t = t.withColumn("src_lang", F.when(F.col("file_id") % 3 == 0, "en-US").otherwise("de")).withColumn("trg_lang", F.lit("en"))
    return scorers.translated(t).select("file_id", "row_idx", "has_translation", "translation")


def summaries(spark, sf):
    """Summaries of files with words; the others are skipped before."""
    return scorers.summarised(file_text(spark, sf).where(~X.is_blank(F.col("text"))), 600)


def outcomes(spark, sf) -> DataFrame:
    """The composite of a job, one row a file: (file_id, rows, skipped, translated, words, summary, flagged).

    Every seventh file is silent and skips all that follows; words are asked for even files, summaries for every third,
    findings for every fifth, and what is not asked for is null. Stand-ins: a summary shows the ends and the number of words of
    what was summarised, and rows whose length is a multiple of eleven are flagged."""
    t = keep(timed(spark, sf).withColumn("text", F.when(F.col("file_id") % 7 == 0, F.lit(" ")).otherwise(sentences.effective())))
    words = X.split_words(F.col("text"))
    made = t.groupBy("file_id").agg(
        F.count("*").alias("rows"), F.bool_and(X.is_blank(F.col("text"))).alias("skipped"), F.max("has_translation").alias("translated"),
        F.sum(F.size(words)).alias("words"), F.count_if(F.length("text") % 11 == 0).alias("flagged"),
    )
    texts = sentences.file_text(t, "row_idx").where("file_id % 3 = 0 and file_id % 7 <> 0")
    made = made.join(scorers.summarised(texts, 600), "file_id", "left")
    on = lambda asked, value: F.when(~F.col("skipped") & asked, value)
    return made.select(
        "file_id", F.when(F.col("skipped"), 0).otherwise(F.col("rows")).cast("long").alias("rows"), "skipped", on(F.lit(True), F.col("translated")).alias("translated"),
        on(F.col("file_id") % 2 == 0, F.col("words")).alias("words"), on(F.col("file_id") % 3 == 0, F.col("summary")).alias("summary"), on(F.col("file_id") % 5 == 0, F.col("flagged")).alias("flagged"),
    )


def job_stages(spark, sf) -> DataFrame:
    """The same as the events of its five stages: two a stage, with what the completed stage reports; a skipped job ends with
    its first."""
    done = outcomes(spark, sf)
    says = [F.col("rows"), F.col("translated").cast("long"), F.col("words"), F.when(F.col("summary").isNotNull(), F.col("summary") != "").cast("long"), F.col("flagged")]
    stages = F.array(*(F.struct(F.lit(i).cast("long").alias("stage_index"), F.lit(name).alias("stage"), s.cast("long").alias("reported")) for i, (name, s) in enumerate(zip(STAGES, says, strict=True))))
    each = done.select("file_id", F.explode(F.when(F.col("skipped"), F.slice(stages, 1, 1)).otherwise(stages)).alias("s"))
    two = each.select("file_id", "s.*", F.explode(F.array(F.lit("stage_started"), F.lit("stage_completed"))).alias("event"))
    ended = F.col("event") == "stage_completed"
    return two.select("file_id", "stage_index", "stage", "event", ((F.col("stage_index") + ended.cast("int")) / F.lit(5.0)).alias("progress"), F.when(ended, F.col("reported")).alias("reported"))


OUTCOMES = r"""effective AS (SELECT file_id, row_idx, has_translation, CASE WHEN file_id % 7 = 0 THEN ' ' WHEN has_translation THEN translation ELSE text END AS text FROM timed),
asked AS (SELECT file_id, string_agg(text, ' ' ORDER BY row_idx) AS text FROM effective WHERE file_id % 3 = 0 AND file_id % 7 <> 0 GROUP BY file_id),
""" + summary_tables("asked", 600) + r""",
outcomes AS (SELECT file_id, CASE WHEN file_id % 7 = 0 THEN 0 ELSE n END AS rows, file_id % 7 = 0 AS skipped, CASE WHEN file_id % 7 <> 0 THEN tr END AS translated,
  CASE WHEN file_id % 7 <> 0 AND file_id % 2 = 0 THEN w END AS words, CASE WHEN file_id % 7 <> 0 AND file_id % 3 = 0 THEN summary END AS summary,
  CASE WHEN file_id % 7 <> 0 AND file_id % 5 = 0 THEN f END AS flagged FROM (
  SELECT file_id, count(*) AS n, bool_or(has_translation) AS tr, sum(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')))::BIGINT AS w,
    count_if(length(text) % 11 = 0)::BIGINT AS f FROM effective GROUP BY file_id) LEFT JOIN summaries USING (file_id))"""


def with_outcomes(sql: str) -> str:
    return with_timed("").rstrip() + ",\n" + OUTCOMES + "\n" + sql


def moody(texts: list[str]) -> list[str | None]:
    """Stand-in for a summariser that is away for some texts and cannot hold others."""
    if any(t.startswith("(away)") for t in texts):
        raise ConnectionError("away")
    if any(t.startswith("(dense)") or len(t) > 300 for t in texts):
        raise ValueError("This model's maximum context length is 300")
    return scorers.ends_and_count(texts)


def careful_summaries(spark, sf):
    """Summaries of texts some of which overflow at any budget, or at the first, or meet an outage."""
    mark = F.when(F.col("file_id") % 5 == 0, "(away) ").when(F.col("file_id") % 5 == 1, "(dense) ").otherwise("")
    return scorers.summarised(file_text(spark, sf).withColumn("text", F.concat(mark, "text")), 600, moody)


def effective_summaries(spark, sf):
    t = timed(spark, sf).withColumn("text", sentences.effective())
    return scorers.summarised(sentences.file_text(t, "row_idx").where(~X.is_blank(F.col("text"))), 600)


ONE = with_tables
FILE_TEXTS = "texts AS (SELECT file_id, string_agg(text, ' ' ORDER BY seg_idx) AS text FROM segments GROUP BY file_id)"


def with_summaries(texts: str, budget: int, sql: str = "SELECT * FROM summaries") -> str:
    """A statement over the stand-in's summaries of `texts`, whose definition ends the common tables given."""
    return f"{texts},\n{summary_tables('texts', budget)}\n{sql}"


QUERIES = {
    "join_overlap_argmax": (overlap_words, ONE("SELECT * FROM word_speakers", "word_speakers")),
    "agg_overlap_sum": (overlap_sums, ONE("""SELECT w.file_id, w.word_idx, t.speaker, sum(least(w.end_s, t.end_s) - greatest(w.start_s, t.start_s)) AS total
      FROM words w JOIN turns t ON w.file_id = t.file_id AND least(w.end_s, t.end_s) > greatest(w.start_s, t.start_s) GROUP BY ALL""", "words", "turns")),
    "join_segment_overlap": (segment_overlap, ONE("SELECT s.file_id, s.seg_idx, p.speaker FROM segments s LEFT JOIN segment_speakers p USING (file_id, seg_idx)", "segments", "segment_speakers")),
    "join_word_in_segment": (word_in_segment, ONE("SELECT file_id, seg_idx, word_idx FROM in_segment", "in_segment")),
    "join_nearest_turn": (filled, ONE("SELECT * FROM filled_segments", "filled_segments")),
    "join_interval_crop": (interval_crop, ONE("""SELECT t.file_id, t.turn_idx, greatest(t.start_s, s.start_s) AS start_s, least(t.end_s, s.end_s) AS end_s, t.speaker FROM turns t
      JOIN segments s ON t.file_id = s.file_id AND least(t.end_s, s.end_s) > greatest(t.start_s, s.start_s) WHERE s.seg_idx % 4 <> 1 AND s.file_id % 5 <> 0
      UNION ALL SELECT file_id, turn_idx, start_s, end_s, speaker FROM turns WHERE file_id % 5 = 0""", "turns", "segments")),
    "win_canonical_speaker": (canonical, ONE("""SELECT file_id, turn_idx, start_s, end_s, 'Speaker ' || dense_rank() OVER (PARTITION BY file_id ORDER BY f) AS speaker FROM (
      SELECT *, min((start_s, turn_idx)) OVER (PARTITION BY file_id, speaker) AS f FROM turns)""", "turns")),
    "win_renumber_appearance": (renumber, ONE("SELECT * FROM named_segments", "named_segments")),
    "win_speaker_runs": (runs, ONE(RUNS, "run_words")),
    "win_run_segment": (runs, ONE(RUNS, "run_words")),
    "win_split_segment": (lambda s, d: speakers.split_segments(D.segments(s, d), D.words(s, d), D.turns(s, d)), ONE("SELECT * FROM split_segments", "split_segments")),
    "win_sentence_merge": (turn_merge, ONE(MERGED, "turn_segments")),
    "win_sentence_index": (lambda s, d: turn_merge(s, d).select("file_id", "row_idx", "start_s"), ONE(f"SELECT file_id, row_idx, start_s FROM ({MERGED})", "turn_segments")),
    "win_boundary_windows": (boundary_rows, with_ends("SELECT file_id, run_idx::BIGINT AS run_idx, place, mark FROM ends WHERE mark IS NOT NULL")),
    "win_first_dedupe": (lambda s, d: boundary_rows(s, d).select("file_id", "run_idx", F.floor(F.col("place") / 400).alias("window_idx"), (F.col("place") % 400).alias("index"), "mark"), with_ends("SELECT file_id, run_idx::BIGINT AS run_idx, place // 400 AS window_idx, place % 400 AS index, mark FROM ends WHERE mark IS NOT NULL")),
    "win_restore_sentences": (restored, RESTORED),
    "ml_boundaries": (ml_boundaries, with_ends("SELECT file_id, run_idx::BIGINT AS run_idx, place, '.' AS mark FROM ends WHERE mark IS NOT NULL")),
    "fn_build_tokens": (lambda s, d: sentences.tokens(windows(s, d)), with_ends("""SELECT file_id, run_idx::BIGINT AS run_idx, place // 400 AS window_idx, count(*) AS n,
      string_agg((place % 400) || chr(9) || word, chr(10) ORDER BY place) AS tokens FROM ends GROUP BY ALL""")),
    "prj_has_speaker": (shown, with_timed("SELECT file_id, row_idx, has_speaker, speaker FROM timed")),
    "prj_ui_has_speaker": (ui_flags, with_timed("SELECT file_id, bool_or(coalesce(speaker <> '', false)) AS has_speaker, bool_or(coalesce(translation <> '', false)) AS has_translation FROM timed GROUP BY file_id")),
    "prj_effective_text": (effective, with_timed("SELECT file_id, row_idx, coalesce(translation, text) AS text FROM timed")),
    "flt_no_speech": (no_speech, ONE("SELECT file_id, seg_idx, start_s, end_s, text, CASE WHEN seg_idx % 13 <> 0 THEN no_speech_prob END AS no_speech_prob FROM segments WHERE seg_idx % 13 = 0 OR no_speech_prob <= 0.6::DOUBLE", "segments")),
    "src_vad": (speech_guard, ONE("SELECT DISTINCT file_id FROM words WHERE file_id % 3 <> 1", "words")),
    "src_asr": (asr, ONE("SELECT * FROM segments", "segments")),
    "src_diarize": (diarized, ONE("SELECT * FROM turns WHERE file_id % 4 <> 0", "turns")),
    "flt_nonempty_transcript": (nonempty, ONE("SELECT DISTINCT file_id, file_id % 3 = 0 AS skipped, CASE WHEN file_id % 3 = 0 THEN 'no speech' END AS skip_reason FROM words", "words")),
    "agg_file_text": (file_text, ONE("SELECT file_id, string_agg(text, ' ' ORDER BY seg_idx) AS text FROM segments GROUP BY file_id", "segments")),
    "agg_punct_ratio": (punct, PUNCT),
    "flt_low_punct": (lambda s, d: punct(s, d).where(speakers.low_punctuation(F.col("ratio"))).select("doc_id"), f"SELECT doc_id FROM ({PUNCT}) WHERE ratio < 0.01::DOUBLE"),
    "agg_distinct_speakers": (distinct_speakers, ONE("SELECT file_id, count(DISTINCT speaker) AS speakers FROM filled_segments GROUP BY file_id", "filled_segments")),
    "agg_stage_delta": (stage_delta, ONE("""SELECT * FROM (SELECT file_id, count(*) AS segments FROM segments GROUP BY file_id) JOIN (
      SELECT file_id, count(*) AS rows, sum(length(text))::BIGINT AS characters FROM transcript GROUP BY file_id) USING (file_id)""", "transcript")),
    "arr_subsample": (subsample_rows, ONE("""SELECT file_id, seg_idx FROM (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM segments) WHERE n <= 20
      OR seg_idx IN (SELECT floor(i * (n / 20.0::DOUBLE))::BIGINT FROM range(20) r(i))""", "segments")),
    "ml_translate": (translated, ONE("""SELECT file_id, row_idx, file_id % 4 <> 3 AND file_id % 3 <> 0 AS has_translation,
      CASE WHEN file_id % 4 <> 3 AND file_id % 3 <> 0 THEN translate(text, 'aeiou', 'AEIOU') END AS translation FROM transcript""", "transcript")),
    "agg_mapreduce_summary": (summaries, with_summaries(with_tables("", "segments").rstrip() + ",\n" + FILE_TEXTS, 600)),
    "ml_summary": (careful_summaries, with_summaries(with_tables("", "segments").rstrip() + ",\n" + FILE_TEXTS, 300, "SELECT file_id, CASE WHEN file_id % 5 < 2 THEN '' ELSE summary END AS summary FROM summaries")),
    "pipe_summary": (effective_summaries, with_summaries(with_timed("").rstrip() + ",\ntexts AS (SELECT file_id, string_agg(CASE WHEN has_translation THEN translation ELSE text END, ' ' ORDER BY row_idx) AS text FROM timed GROUP BY file_id)", 600)),
    "pipe_transcription": (transcript, ONE("SELECT * FROM transcript", "transcript")),
    "pipe_job": (job_stages, with_outcomes("""SELECT file_id, i AS stage_index, s AS stage, e AS event, (i + CASE e WHEN 'stage_completed' THEN 1 ELSE 0 END)::DOUBLE / 5::DOUBLE AS progress,
      CASE WHEN e = 'stage_completed' THEN CASE i WHEN 0 THEN rows WHEN 1 THEN translated::BIGINT WHEN 2 THEN words WHEN 3 THEN (summary <> '')::BIGINT ELSE flagged END END AS reported
      FROM outcomes, (VALUES (0::BIGINT, 'Transcribing'), (1, 'Translating'), (2, 'Running word-level analysis'), (3, 'Summarizing'), (4, 'Detecting hate speech')) v(i, s), (VALUES ('stage_started'), ('stage_completed')) k(e)
      WHERE i = 0 OR NOT skipped""")),
    "pipe_cli": (outcomes, with_outcomes("SELECT * FROM outcomes")),
    "fn_seconds_to_time": (lambda s, d: D.segments(s, d).select("file_id", "seg_idx", X.clock(F.col("start_s") * 1001 + 0.5).alias("clock")), ONE(f"SELECT file_id, seg_idx, {clock_sql('(start_s * 1001 + 0.5::DOUBLE)')} AS clock FROM segments", "segments")),
    "fn_format_hhmmss": (lambda s, d: D.segments(s, d).select("file_id", "seg_idx", X.stamp(F.col("start_s") * 1001).alias("stamp")), ONE("""SELECT file_id, seg_idx, CASE WHEN t // 3600 < 10 THEN '0' ELSE '' END || (t // 3600) || ':' || lpad(((t % 3600) // 60)::VARCHAR, 2, '0') || ':' || lpad((t % 60)::VARCHAR, 2, '0') AS stamp
      FROM (SELECT *, floor(start_s * 1001)::BIGINT AS t FROM segments)""", "segments")),
    "fn_parse_hhmmss": (lambda s, d: D.segments(s, d).select("file_id", "seg_idx", X.parse_clock(X.clock(F.col("start_s") * 1001)).alias("seconds")), ONE("SELECT file_id, seg_idx, round_even(start_s * 1001, 0)::DOUBLE AS seconds FROM segments", "segments")),
    "fn_ends_terminal": (lambda s, d: D.segments(s, d).select("file_id", "seg_idx", X.ends_sentence(F.col("text")).alias("ends")), ONE(r"SELECT file_id, seg_idx, regexp_matches(text, '[.!?؟۔]\s*$') AS ends FROM segments", "segments")),
    "fn_sentence_text": (lambda s, d: D.segments(s, d).select("file_id", "seg_idx", X.sentence(F.col("text"), F.lit("؟")).alias("text")), ONE("SELECT file_id, seg_idx, CASE WHEN regexp_matches(text, '[.!?؟۔]$') THEN text ELSE text || '؟' END AS text FROM segments", "segments")),
}
QUERIES["ml_asr"] = QUERIES["src_asr"]
QUERIES["pipe_translation"] = QUERIES["ml_translate"]
