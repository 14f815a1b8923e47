"""The transcript's two plans: which files take which, and what becomes of outages and failures of the model."""

from pyspark.sql import functions as F

from parlance.operators import scorers, sentences
from parlance.sources import derived as D


def recording(spark, texts):
    """Segments of six words, words half a second apart, and one turn a file, of texts by file."""
    rows = [(i, k, 0, "user", w, k * 0.5, k * 0.5 + 0.25) for i, t in texts.items() for k, w in enumerate(t.split())]
    words = spark.createDataFrame(rows, "file_id long, word_idx long, turn long, role string, word string, start_s double, end_s double")
    turns = spark.createDataFrame([(i, 0, 0.0, 1000.0, "SPEAKER_00") for i in texts], "file_id long, turn_idx long, start_s double, end_s double, speaker string")
    return D.segments_of(words), words, turns


def test_marks_decide_and_failures_fall_back(spark):
    plain = [f"w{k}" for k in range(25)]
    texts = {1: " ".join(plain), 2: " ".join(plain[:12]) + ". " + " ".join(plain[12:]) + ".", 3: "(unreadable) " + " ".join(plain), 4: "(absent) " + " ".join(plain)}
    segments, words, turns = recording(spark, texts)
    assert sorted(r["file_id"] for r in sentences.unmarked(segments, words).collect()) == [1, 3, 4]
    got = {}
    for r in sentences.transcript(segments, words, turns, scorers.unsteady_tenth).orderBy("file_id", "row_idx").collect():
        got.setdefault(r["file_id"], []).append(r["text"])
    assert got[1] == [" ".join(plain[:10]) + ".", " ".join(plain[10:20]) + ".", " ".join(plain[20:]) + "."]
    assert got[2] == [" ".join(plain[:12]) + ".", " ".join(plain[12:]) + "."]
    assert got[3] == [texts[3]]  # a call failed: as it was, without a mark
    assert got[4] == [texts[4] + "."]  # the model was away: one sentence


def test_files_without_words_are_not_restored(spark):
    segments, words, turns = recording(spark, {1: "one two three four five six seven"})
    none = words.where(F.lit(False))
    assert sentences.unmarked(segments, none).count() == 0
    got = sentences.transcript(segments, none, turns).collect()
    assert [r["text"] for r in got] == ["one two three four five six seven"]
