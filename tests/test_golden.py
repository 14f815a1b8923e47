"""Cases with known answers, for rules that SQL cannot express or that the test tables never reach."""

import pytest
from pyspark.sql import functions as F

from parlance.functions import settings
from parlance.functions import text as X
from parlance.operators import counts, jobs, profiles, scorers, sentences, speakers
from parlance.plans import texts
from parlance.sources import files

C = F.col


def values(spark, kind, items, make):
    """make(column) of each item, in order."""
    df = spark.createDataFrame(list(enumerate(items)), f"i int, x {kind}")
    return [r["y"] for r in df.select("i", make(C("x")).alias("y")).orderBy("i").collect()]


def test_times(spark):
    assert values(spark, "double", [0.0, 3661.0, 90.4, 2.5, 90000.0], X.clock) == ["0:00:00", "1:01:01", "0:01:30", "0:00:02", "1 day, 1:00:00"]
    assert values(spark, "double", [0.0, 3661.9, 360000.0], X.stamp) == ["00:00:00", "01:01:01", "100:00:00"]
    assert values(spark, "string", ["0:01:30", "1 day, 1:00:00", "soon", None], X.parse_clock) == [90.0, 90000.0, None, None]


def test_marks(spark):
    assert values(spark, "string", ["Yes.", "Yes? ", "نعم؟", "and", "wait…", ""], X.ends_sentence) == [True, True, True, False, False, False]
    assert values(spark, "string", ["One. Two three.", "no marks", " "], X.punctuation_ratio) == [pytest.approx(2 / 3), 0.0, 0.0]


def test_packing(spark):
    texts = ["aa bb cc", "abcdefghij k", "  ", "word " * 50]
    got = values(spark, "string", texts, lambda c: X.packed(c, 5))
    assert got[0] == ["aa bb", "cc"] and all(len(p) <= 5 for p in got[1] + got[3])
    assert "".join(got[1]).replace(" ", "") == "abcdefghijk" and got[2] == ["  "] and " ".join(got[3]).split() == texts[3].split()


def test_split_budget_keeps_long_and_null_texts(spark, tmp_path):
    long = "abcd " * 30_000 + "z" * 1001
    spark.createDataFrame([(1, long), (2, None), (3, "short")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in texts.packed(spark, str(tmp_path)).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    assert got[2] == [None] and got[3] == ["short"]
    assert all(len(c) <= 200 for c in got[1]) and "".join(got[1]).replace(" ", "") == long.replace(" ", "")
    assert len(got[1]) == 30_000 // 40 + 6 and got[1][0] == " ".join(["abcd"] * 40)


def test_entity_chunks(spark):
    got = values(spark, "string", ["One two. Three four five. Six.", "a b c d e f g h.", "  "], lambda c: X.entity_chunks(c, 5))
    assert got[0] == ["One two. Three four five.", "Six."] and got[1] == ["a b c d e"] and got[2] == []


def test_subsample_and_names(spark):
    assert values(spark, "array<int>", [[*range(8)], [1, 2], []], lambda c: X.subsample(c, F.lit(4))) == [[0, 2, 4, 6], [1, 2], []]
    assert values(spark, "string", ["a b/ü.MP3", "...", "._x_", ""], X.safe_name) == ["a_b__.MP3", "result", "x", "result"]
    assert values(spark, "string", ["a.tar.gz", ".hidden", "", "plain"], X.stem) == ["a.tar", ".hidden", "result", "plain"]


def test_detection_replies(spark):
    raw = ['{"hate_speech": true, "category": "Insult", "confidence": "HIGH", "reason": "r"}', 'so: {"hate_speech": "yes", "category": "x", "confidence": "sure", "reason": "q"} ok', "nothing", "{broken", None]
    got = values(spark, "string", raw, X.detection)
    assert (got[0]["hate_speech"], got[0]["category"], got[0]["confidence"]) == (True, "insult", "high")
    assert (got[1]["hate_speech"], got[1]["confidence"]) == (True, "low")
    assert all((g["hate_speech"], g["category"], g["confidence"], g["reason"]) == (False, "none", "low", "Parse error") for g in got[2:4])


def turns(spark, rows):
    return spark.createDataFrame([(1, i, float(s), float(e), who) for i, (s, e, who) in enumerate(rows)], "file_id long, turn_idx long, start_s double, end_s double, speaker string")


def items(spark, rows):
    return spark.createDataFrame([(1, i, float(s), float(e), who) for i, (s, e, who) in enumerate(rows)], "file_id long, seg_idx long, start_s double, end_s double, speaker string")


def test_nearest_turn(spark):
    given = items(spark, [(10, 11, None), (4, 5, None), (10, 11, "Z"), (0, 1, None)])
    got = speakers.nearest(given, turns(spark, [(2, 3, "A"), (6, 7, "B"), (12, 13, "C")]), ["seg_idx"]).orderBy("seg_idx").collect()
    assert [r["speaker"] for r in got] == ["C", "A", "Z", "A"]
    none = speakers.nearest(given, turns(spark, []), ["seg_idx"]).orderBy("seg_idx").collect()
    assert [r["speaker"] for r in none] == [None, None, "Z", None]


def test_longest_overlap_in_all(spark):
    met = speakers.by_overlap(items(spark, [(0, 10, None), (0, 2, None), (20, 21, None)]).drop("speaker"), turns(spark, [(0, 3, "A"), (3, 7, "B"), (7, 10, "A"), (1, 2, "C")]), ["seg_idx"])
    assert {r["seg_idx"]: r["speaker"] for r in met.collect()} == {0: "A", 1: "A"}


def test_sentences_merge_at_marks_and_speakers(spark):
    rows = [(1, 0, 0.0, 1.0, "A", "Hello"), (1, 1, 1.0, 2.0, "A", "there."), (1, 2, 2.0, 3.0, "A", "And"), (1, 3, 3.0, 4.0, "B", "you"), (1, 4, 4.0, 5.0, "B", " ")]
    df = spark.createDataFrame(rows, "file_id long, seg_idx long, start_s double, end_s double, speaker string, text string")
    got = sentences.merged(df, ["seg_idx"]).orderBy("row_idx").collect()
    assert [(r["speaker"], r["text"]) for r in got] == [("A", "Hello there."), ("A", "And"), ("B", "you")]


def test_summary_ends_when_summaries_do_not_shrink(spark):
    df = spark.createDataFrame([(1, "word " * 400), (2, "short text")], "file_id long, text string")
    got = {r["file_id"]: r["summary"] for r in scorers.summarised(df, 60, lambda texts: [t + " more" for t in texts]).collect()}
    assert set(got) == {1, 2} and got[2] == "short text more"


def test_summary_halves_the_budget_of_files_that_overflow(spark):
    rows = [(1, "word " * 400), (2, "short text"), (3, "broken " * 3 + "word " * 30), (4, "dense " * 100)]
    df = spark.createDataFrame(rows, "file_id long, text string")

    def scorer(texts):
        if any(len(t) > 40 or "dense" in t for t in texts):
            raise ValueError("This model's maximum context length is 40")
        if any("broken" in t for t in texts):
            raise ConnectionError
        return [f"{len(t)}" for t in texts]

    got = {r["file_id"]: r["summary"] for r in scorers.summarised(df, 120, scorer).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2] == "10" and got[3] == got[4] == "" and got[1].isdigit()


def test_settings_never_fail():
    assert settings.upload_cap({"UPLOAD_MAX_MIB": "x"}) == 8192 << 20 and settings.upload_cap({"UPLOAD_MAX_MIB": "0"}) == 1 << 20
    assert settings.concurrency({"JOB_CONCURRENCY": "-3"}) == 1 and settings.summary_budget({}) == 18000


def test_summary_of_nothing_is_an_error_of_its_file(spark):
    df = spark.createDataFrame([(1, "some words here"), (2, ""), (3, None)], "file_id long, text string")
    with pytest.raises(Exception, match="no text to summarise in file [23]"):
        scorers.summarised(df, 60).collect()
    got = {r["file_id"]: r["summary"] for r in scorers.summarised(df, 60, strict=False).collect()}
    assert got == {1: "some here 3", 2: None, 3: None}


def test_each_chunk_reaches_the_summary(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "file_id long, text string")
    seen = {r["file_id"]: r["summary"] for r in scorers.summarised(df, 40, lambda texts: [t.split()[-1] for t in texts]).collect()}
    assert seen == {1: "w29"}


def test_whole_entity_chunks_lose_no_word(spark):
    text = "a b c d e f g h. i j! " + "k " * 12
    for budget in (1, 3, 5, 100):
        chunks = values(spark, "string", [text, " ", ""], lambda c, n=budget: X.entity_chunks(c, n, whole=True))
        assert " ".join(chunks[0]).split() == text.split() and all(len(c.split()) <= budget for c in chunks[0]) and chunks[1:] == [[], []]


def test_a_chunk_that_fails_costs_only_its_own_entities(spark):
    df = spark.createDataFrame([(1, "Anna met. (unreadable) Bert. Carla left."), (2, "Dora, Dora"), (3, None)], "file_id long, text string")
    found = counts.entity_tally(counts.recognised(df, texts.capital_pairs, budget=3)).collect()
    assert {(r["file_id"], r["entity"], r["frequency"]) for r in found} == {(1, "Anna", 1), (1, "Carla", 1), (2, "Dora", 2)}


def test_languages_by_profile(spark):
    known = spark.createDataFrame([("x", "abab abab"), ("y", "cdcd cd"), (None, "zzzz")], "lang string, text string")
    asked = spark.createDataFrame([(1, "Abab!"), (2, "cd, CD"), (3, ""), (4, None), (5, "12 34"), (6, "qq")], "file_id long, text string")
    got = {r["file_id"]: (r["language"], r["distance"]) for r in profiles.detected(asked, profiles.learned(known)).collect()}
    assert got[1][0] == "x" and got[2][0] == "y" and all(got[i] == ("en", None) for i in (3, 4, 5))
    assert got[6][1] is None or got[6][1] > 0


def test_place_distances_by_plain_counting(spark):
    def ranks(text, size):
        n = {}
        for w in text.lower().split():
            w = f"_{w}_"
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    if w[i : i + k] != "_":
                        n[w[i : i + k]] = n.get(w[i : i + k], 0) + 1
        return {g: i + 1 for i, g in enumerate(sorted(n, key=lambda g: (-n[g], g))[:size])}

    langs, text = {"x": "the cat and the dog", "y": "le chat et le chien"}, "the chat"
    df = spark.createDataFrame(list(langs.items()), "lang string, text string")
    got = profiles.detected(spark.createDataFrame([(1, text)], "file_id long, text string"), profiles.learned(df, 8), 8).collect()[0]
    own = ranks(text, 8)
    far = {k: sum(abs(p - ranks(t, 8)[g]) if g in ranks(t, 8) else 8 for g, p in own.items()) for k, t in langs.items()}
    assert (got["language"], got["distance"]) == min(((k, d) for k, d in far.items()), key=lambda kd: (kd[1], kd[0]))


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    found = texts.detected(spark, sf).join(texts.docs(spark, sf).select("file_id", "lang"), "file_id").where("held_out")
    right, n = found.agg(F.count_if(C("lang") == C("language")), F.count("*")).collect()[0]
    assert n >= 150 and right / n >= 0.95, right / n


def test_figures_are_gathered_while_a_table_is_written(spark):
    kept, seen = jobs.observed(spark.range(100), rows=F.count("*"), even=F.count_if(C("id") % 2 == 0), none=F.sum(F.lit(None).cast("long")))
    assert seen == {"rows": 100, "even": 50, "none": 0} and kept.count() == 100


def test_refused_uploads_are_not_read(spark, tmp_path):
    rows = spark.createDataFrame([("a", b"12345"), ("b", b"123456"), ("c", b"")], "name string, content binary")
    files.write(rows, f"{tmp_path}/in", [])
    got = files.received(spark, f"{tmp_path}/in", 5)
    assert {(r["name"], r["length"], r["accepted"], r["digest"] is None) for r in got.collect()} == {("a", 5, True, False), ("c", 0, True, False), ("b", 6, False, True)}
    plan = got._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,5)" in plan and "GreaterThan(length,5)" in plan
    scans = [line for line in plan.split("== Physical Plan ==")[1].splitlines() if "FileScan binaryFile" in line]
    assert len(scans) == 2 and "content" not in next(line for line in scans if "GreaterThan" in line)
