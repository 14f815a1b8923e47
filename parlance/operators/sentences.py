"""Sentences from segments or words: merging, boundaries and restoration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as X
from parlance.operators import scorers, speakers
from parlance.sources.derived import in_order
from parlance.sources.folders import keep

WINDOW_WORDS = 400
#: Sentence marks a word below which a file's sentences are restored.
LEAST_MARKS = 0.01


def merged(rows: DataFrame, order: list[str]) -> DataFrame:
    """(file_id, row_idx, start_s, end_s, speaker, text): rows joined until one ends a sentence or the speaker changes.

    Rows of blank text carry no words: a group begins with the first row after a boundary, blank or not, and takes that
    row's start and speaker; a speaker change cuts only where the sentence so far has words. Groups without words are
    dropped. Where no row is blank this is: a new sentence after a row that ends one, or whose speaker differs."""
    by = Window.partitionBy("file_id").orderBy(*order)
    blank = X.is_blank(F.col("text"))
    # the last row with words before this one, and whether a sentence ended since
    last = F.last(F.when(~blank, F.struct("speaker", X.ends_sentence(F.col("text")).alias("ended"))), ignorenulls=True)
    seen = rows.withColumn("blank", blank).withColumn("prev", last.over(by.rowsBetween(Window.unboundedPreceding, -1)))
    seen = seen.withColumn("prev_blank", F.lag("blank").over(by))
    opened = F.col("prev").isNotNull() & ~F.col("prev.ended")
    changed = opened & ~F.col("speaker").eqNullSafe(F.col("prev.speaker"))
    # of the rows since the last one with words only the first with another speaker cuts
    stretch = F.count(F.when(~F.col("blank"), 1)).over(by.rowsBetween(Window.unboundedPreceding, -1))
    seen = seen.withColumn("changed", changed).withColumn("stretch", stretch)
    sooner = Window.partitionBy("file_id", "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("changed", F.col("changed") & (F.coalesce(F.count_if("changed").over(sooner), F.lit(0)) == 0))
    cut = F.when(F.col("changed") | (F.coalesce(F.col("prev.ended"), F.lit(False)) & ~F.coalesce(F.col("prev_blank"), F.lit(False))), 1).otherwise(0)
    numbered = seen.withColumn("sentence", F.sum(cut).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    key = F.struct(*order)
    words = F.array_sort(F.collect_list(F.when(~F.col("blank"), F.struct(key.alias("k"), X.strip(F.col("text")).alias("t")))))
    made = numbered.groupBy("file_id", "sentence").agg(
        F.min_by("start_s", key).alias("start_s"), F.max_by("end_s", key).alias("end_s"), F.min_by("speaker", F.when(F.col("speaker").isNotNull(), key)).alias("speaker"),
        F.array_join(F.transform(words, lambda w: w["t"]), " ").alias("text"),
    )
    idx = (F.row_number().over(Window.partitionBy("file_id").orderBy("sentence")) - 1).cast("long")
    return made.where(F.col("text") != "").select("file_id", idx.alias("row_idx"), "start_s", "end_s", "speaker", "text")


def run_windows(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Words with speaker, run_idx, their place in the run, and the window of WINDOW_WORDS that it falls in."""
    numbered = speakers.runs(speakers.labelled(words, turns, ["word_idx"]), ["file_id"])
    place = (F.row_number().over(Window.partitionBy("file_id", "run_idx").orderBy("word_idx")) - 1).cast("long")
    return numbered.withColumn("place", place).withColumn("window_idx", F.floor(F.col("place") / WINDOW_WORDS))


def tokens(windows: DataFrame) -> DataFrame:
    """(file_id, run_idx, window_idx, n, tokens): the numbered word list that a boundary model gets."""
    at = F.col("place") - F.col("window_idx") * WINDOW_WORDS
    line = windows.withColumn("line", F.concat(at.cast("string"), F.lit("\t"), X.strip(F.col("word"))))
    return line.groupBy("file_id", "run_idx", "window_idx").agg(F.count("*").alias("n"), in_order("line", "place", "\n").alias("tokens"))


def boundaries(windows: DataFrame, replies: DataFrame) -> DataFrame:
    """(file_id, run_idx, place, mark): where sentences end, from replies (file_id, run_idx, window_idx, reply).

    The first pair for an index counts; each window's last word always ends a sentence; windows with a null reply, or
    none at all, are one sentence."""
    sizes = windows.groupBy("file_id", "run_idx", "window_idx").agg(F.count("*").alias("n"))
    known = sizes.join(replies, ["file_id", "run_idx", "window_idx"], "left")
    pairs = X.boundaries(F.coalesce("reply", F.lit("")), F.col("n"))
    forced = F.array(F.struct((F.col("n") - 1).alias("index"), F.lit(".").alias("mark")))
    every = known.withColumn("pair", F.explode(X.first_by_index(F.concat(pairs, forced))))
    return every.select("file_id", "run_idx", (F.col("window_idx") * WINDOW_WORDS + F.col("pair.index")).alias("place"), F.col("pair.mark").alias("mark"))


def restored(windows: DataFrame, ends: DataFrame) -> DataFrame:
    """(file_id, run_idx, sentence, start_s, end_s, speaker, text): runs cut at boundaries, a mark added where none is."""
    marked = windows.join(ends, ["file_id", "run_idx", "place"], "left")
    order = Window.partitionBy("file_id", "run_idx").orderBy("place")
    before = F.coalesce(F.sum(F.when(F.col("mark").isNotNull(), 1)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    label = F.max("speaker").over(Window.partitionBy("file_id", "run_idx"))
    cut = marked.withColumn("sentence", before).withColumn("label", label).withColumn("word", X.strip(F.col("word")))
    made = cut.groupBy("file_id", "run_idx", "sentence").agg(
        F.min_by("start_s", "place").alias("start_s"), F.max_by("end_s", "place").alias("end_s"), F.max("label").alias("speaker"),
        X.strip(in_order("word", "place")).alias("text"), F.max("mark").alias("mark"),
    )
    return made.withColumn("text", X.sentence(F.col("text"), F.coalesce("mark", F.lit(".")))).drop("mark")


def unmarked(segments: DataFrame, words: DataFrame, threshold: float = LEAST_MARKS) -> DataFrame:
    """(file_id): files with words whose segments have fewer sentence marks a word than the threshold."""
    counted = segments.groupBy("file_id").agg(F.sum(X.marks(F.col("text"))).alias("marks"), F.sum(F.size(X.split_words(F.col("text")))).alias("many"))
    low = speakers.low_punctuation(F.when(F.col("many") > 0, F.col("marks") / F.col("many")).otherwise(F.lit(0.0)), threshold)
    return counted.where(low).select("file_id").join(words.select("file_id").distinct(), "file_id", "left_semi")


def restoration(words: DataFrame, turns: DataFrame, scorer: scorers.Scorer) -> tuple[DataFrame, DataFrame]:
    """(file_id, seg_idx, part, start_s, end_s, text, speaker) of restored sentences, and the files (file_id) of which a call
    failed, whose sentences are not among them. A window that got no answer is one sentence."""
    windows = keep(run_windows(words, turns))
    replies = keep(scorers.attempted(tokens(windows), "tokens", scorer))
    lost = replies.where("failed").select("file_id").distinct()
    made = restored(windows, boundaries(windows, replies.select("file_id", "run_idx", "window_idx", "reply"))).join(lost, "file_id", "left_anti")
    return made.select("file_id", F.col("run_idx").alias("seg_idx"), F.col("sentence").alias("part"), "start_s", "end_s", "text", "speaker"), lost


def transcript(segments: DataFrame, words: DataFrame, turns: DataFrame, scorer: scorers.Scorer = scorers.every_tenth, threshold: float = LEAST_MARKS) -> DataFrame:
    """The composite: files with hardly a sentence mark take sentences restored from their words, all others are split by
    speaker; then fill from the nearest turn, renumber, merge to sentences.

    A file goes through one of the two plans, decided by its marks a word; files without words, and files of which a call to
    the model failed, are split by speaker too."""
    low = keep(unmarked(segments, words, threshold))
    made, lost = restoration(words.join(low, "file_id", "left_semi"), turns, scorer)
    done = keep(low.join(lost, "file_id", "left_anti"))
    rest = lambda rows: rows.join(done, "file_id", "left_anti")
    split = speakers.split_segments(rest(segments), rest(words), turns)
    rows = keep(split.unionByName(made))  # three branches read it
    filled = speakers.nearest(rows, turns, ["seg_idx", "part"])
    return merged(speakers.renumbered(filled, ["seg_idx", "part"]), ["seg_idx", "part"])


def file_text(rows: DataFrame, by: str, text: str = "text") -> DataFrame:
    """(file_id, text): a file's texts in order, joined by one blank."""
    return rows.groupBy("file_id").agg(in_order(text, by).alias("text"))


def effective(text: str = "text", translation: str = "translation", has: str = "has_translation") -> Column:
    return F.when(F.col(has), F.col(translation)).otherwise(F.col(text))


def subsampled(rows: DataFrame, target: int, by: str) -> DataFrame:
    """`target` evenly spread rows a file (see functions.text.subsample), without gathering a file in one array."""
    n = F.count("*").over(Window.partitionBy("file_id"))
    i = F.row_number().over(Window.partitionBy("file_id").orderBy(by)) - 1
    numbered = rows.withColumn("n", n).withColumn("i", i)
    step = F.col("n") / F.lit(target)
    # i is picked if it is floor(slot * step) for a slot; i / step is next to that slot, rounding aside
    near = F.floor(F.col("i") / step)
    hit = [(F.floor((near + k) * step) == F.col("i")) & (near + k >= 0) & (near + k < target) for k in (-1, 0, 1, 2)]
    picked = (F.col("n") <= target) | hit[0] | hit[1] | hit[2] | hit[3]
    return numbered.where(picked if target > 0 else F.lit(False)).drop("n", "i")
