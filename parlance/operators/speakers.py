"""Who speaks when: interval overlap, nearest turn, runs, splitting and renumbering, for many files at once.

Times are seconds as double. Every table carries file_id and an index column; results do not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.sources.derived import in_order
from parlance.sources.folders import keep

#: Width in seconds of the time buckets by which intervals of one file meet.
BUCKET = 60.0


def overlapping(left: DataFrame, right: DataFrame, width: float = BUCKET) -> DataFrame:
    """Pairs of rows of one file whose intervals share more than a point; right's start and end come as t_start, t_end.

    Both sides are dealt to time buckets, so the join is by (file, bucket), not by file alone: a long file is spread over
    many tasks and is never compared with all of itself. A pair counts in the bucket in which its overlap begins."""
    spans = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    r = right.withColumnRenamed("start_s", "t_start").withColumnRenamed("end_s", "t_end")
    r = r.withColumn("bucket", spans("t_start", "t_end"))
    met = left.withColumn("bucket", spans("start_s", "end_s")).join(r, ["file_id", "bucket"])
    begins = F.greatest("start_s", "t_start")
    return met.where((F.least("end_s", "t_end") > begins) & (F.floor(begins / width) == F.col("bucket"))).drop("bucket")


def by_overlap(items: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """(file_id, keys, speaker): the speaker with the longest overlap in all; among equals the one whose first
    overlapping turn comes first. Items that overlap no turn are absent."""
    met = overlapping(items.select("file_id", *keys, "start_s", "end_s"), turns)
    length = F.least("end_s", "t_end") - F.greatest("start_s", "t_start")
    each = met.groupBy("file_id", *keys, "speaker").agg(F.sum(length).alias("total"), F.min("turn_idx").alias("first_turn"))
    return each.groupBy("file_id", *keys).agg(F.max_by("speaker", F.struct("total", -F.col("first_turn"))).alias("speaker"))


def labelled(items: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """items with speaker, null where no turn overlaps."""
    return items.drop("speaker").join(by_overlap(items, turns, keys), ["file_id", *keys], "left")


def in_segment(words: DataFrame, segments: DataFrame, width: float = BUCKET) -> DataFrame:
    """words with the seg_idx of each segment that holds their midpoint (start included, end not). A word in several
    segments comes several times, one in none not at all."""
    mid = (F.col("start_s") + F.col("end_s")) / 2
    s = segments.select("file_id", "seg_idx", F.col("start_s").alias("s_start"), F.col("end_s").alias("s_end"))
    s = s.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("s_start") / width), F.floor(F.col("s_end") / width))))
    met = words.withColumn("bucket", F.floor(mid / width)).join(s, ["file_id", "bucket"])
    return met.where((mid >= F.col("s_start")) & (mid < F.col("s_end"))).drop("bucket", "s_start", "s_end")


def nearest(items: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """items with null speakers filled from the turn nearest in time; ties go to a turn that does not start after the
    item's end, then to the earlier turn. Files without turns stay as they are.

    Only three turns can be nearest: one that overlaps, the last to end before the item, the first to start after it.
    The latter two come from running extremes over the file's items and turns in time order, without a pair join."""
    open_items = items.where(F.col("speaker").isNull()).select("file_id", *keys, "start_s", "end_s")
    cross = overlapping(open_items, turns).select("file_id", *keys, F.struct(F.lit(0.0).alias("gap"), F.lit(0).alias("after"), F.col("turn_idx").alias("turn_idx")).alias("rank"), "speaker")
    turn = F.struct("turn_idx", "speaker")
    none = F.lit(None)
    key = F.struct(*keys)

    def sweep(item_at: str, turn_at: str, forward: bool) -> DataFrame:
        marks = turns.select("file_id", F.col(turn_at).alias("at"), F.lit(0 if forward else 1).alias("kind"), turn.alias("turn"), none.cast(open_items.select(key.alias("k")).schema["k"].dataType).alias("item"))
        points = open_items.select("file_id", F.col(item_at).alias("at"), F.lit(1 if forward else 0).alias("kind"), none.cast(marks.schema["turn"].dataType).alias("turn"), key.alias("item"))
        order = Window.partitionBy("file_id").orderBy(*(F.col(c).asc() if forward else F.col(c).desc() for c in ("at", "kind")))
        frame = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        best = (F.max if forward else F.min)(F.when(F.col("turn").isNotNull(), F.struct("at", (-F.col("turn.turn_idx") if forward else F.col("turn.turn_idx")).alias("i"), F.col("turn.speaker").alias("speaker")))).over(frame)
        found = marks.unionByName(points).withColumn("best", best).where(F.col("item").isNotNull() & F.col("best").isNotNull())
        gap = F.greatest((F.col("at") - F.col("best.at")) if forward else (F.col("best.at") - F.col("at")), F.lit(0.0))
        after = F.lit(0) if forward else F.when(F.col("best.at") > F.col("at"), 1).otherwise(0)
        rank = F.struct(gap.alias("gap"), after.alias("after"), F.abs("best.i").alias("turn_idx"))
        return found.select("file_id", *(F.col(f"item.{k}").alias(k) for k in keys), rank.alias("rank"), F.col("best.speaker").alias("speaker"))

    every = cross.unionByName(sweep("start_s", "end_s", True)).unionByName(sweep("end_s", "start_s", False))
    chosen = every.groupBy("file_id", *keys).agg(F.min_by("speaker", "rank").alias("nearest"))
    return items.join(chosen, ["file_id", *keys], "left").withColumn("speaker", F.coalesce("speaker", "nearest")).drop("nearest")


def canonical(turns: DataFrame) -> DataFrame:
    """turns with labels renamed to `Speaker n`, n by each label's first start, then turn order."""
    first = F.min(F.struct("start_s", "turn_idx")).over(Window.partitionBy("file_id", "speaker"))
    rank = F.dense_rank().over(Window.partitionBy("file_id").orderBy("first_at"))
    return turns.withColumn("first_at", first).withColumn("speaker", F.concat(F.lit("Speaker "), rank.cast("string"))).drop("first_at")


def renumbered(segments: DataFrame, order: list[str]) -> DataFrame:
    """segments with labels renamed to `Speaker n` by first appearance; null and empty labels stay and count for none."""
    has = F.coalesce(F.col("speaker") != "", F.lit(False))
    first = F.min(F.struct(*order)).over(Window.partitionBy("file_id", "speaker"))
    rank = F.dense_rank().over(Window.partitionBy("file_id", "has").orderBy("first_at"))
    named = segments.withColumn("has", has).withColumn("first_at", first)
    return named.withColumn("speaker", F.when(F.col("has"), F.concat(F.lit("Speaker "), rank.cast("string"))).otherwise(F.col("speaker"))).drop("has", "first_at")


def runs(words: DataFrame, part: list[str]) -> DataFrame:
    """words (with speaker) numbered by run_idx: a run ends only between two different labels; words without one join."""
    order = Window.partitionBy(*part).orderBy("word_idx")
    before = F.last("speaker", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(F.col("speaker") != before, 1).otherwise(0)
    return words.withColumn("cut", cut).withColumn("run_idx", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")).drop("cut")


def run_segments(numbered: DataFrame, part: list[str]) -> DataFrame:
    """A segment for each run: from its first word's start to its last word's end, words trimmed and joined."""
    trimmed = numbered.withColumn("word", F.trim("word"))
    ends = F.max_by("end_s", "word_idx")
    return trimmed.groupBy(*part, "run_idx").agg(F.min("start_s").alias("start_s"), ends.alias("end_s"), in_order("word", "word_idx").alias("text"), F.max("speaker").alias("speaker"))


def split_segments(segments: DataFrame, words: DataFrame, turns: DataFrame) -> DataFrame:
    """(file_id, seg_idx, part, start_s, end_s, text, speaker): a segment whose words have one speaker or none stays as it
    is, with that speaker or else the one of the segment's own overlap; any other is split at speaker changes."""
    inside = keep(in_segment(labelled(words, turns, ["word_idx"]), segments))  # three branches read it
    kinds = inside.groupBy("file_id", "seg_idx").agg(F.count_distinct("speaker").alias("n"), F.min("speaker").alias("one"))
    known = segments.join(kinds, ["file_id", "seg_idx"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = known.where("n <= 1").select("file_id", "seg_idx", "start_s", "end_s", "text", "one")
    whole = whole.join(by_overlap(segments, turns, ["seg_idx"]), ["file_id", "seg_idx"], "left")
    whole = whole.select("file_id", "seg_idx", F.lit(0).cast("long").alias("part"), "start_s", "end_s", "text", F.coalesce("one", "speaker").alias("speaker"))
    mixed = inside.join(kinds.where("n > 1").select("file_id", "seg_idx"), ["file_id", "seg_idx"], "left_semi")
    pieces = run_segments(runs(mixed, ["file_id", "seg_idx"]), ["file_id", "seg_idx"])
    return whole.unionByName(pieces.withColumnRenamed("run_idx", "part"))


def shown(transcript: DataFrame) -> DataFrame:
    """transcript with speaker only in files that have two labels or more (missing ones as `Unknown`), and has_speaker."""
    label = F.when(F.coalesce(F.col("speaker") != "", F.lit(False)), F.col("speaker"))
    several = F.size(F.collect_set(label).over(Window.partitionBy("file_id"))) >= 2
    return transcript.withColumn("has_speaker", several).withColumn("speaker", F.when(F.col("has_speaker"), F.coalesce("speaker", F.lit("Unknown"))))


def cropped(turns: DataFrame, speech: DataFrame) -> DataFrame:
    """Each turn cut to the speech intervals of its file, one row a piece; files without intervals stay as they are."""
    pieces = overlapping(turns, speech.select("file_id", "start_s", "end_s"))
    cut = pieces.withColumn("s", F.greatest("start_s", "t_start")).withColumn("e", F.least("end_s", "t_end"))
    cut = cut.select("file_id", "turn_idx", F.col("s").alias("start_s"), F.col("e").alias("end_s"), "speaker")
    return cut.unionByName(turns.join(speech.select("file_id").distinct(), "file_id", "left_anti").select(*cut.columns))


def low_punctuation(ratio: Column, threshold: float = 0.01) -> Column:
    return ratio < threshold
