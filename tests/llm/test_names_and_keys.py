"""Columns named like an operator's own, and keys that are no whole numbers, through every operator on documents."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import divergence, licences, mixing, neardup, pieces, quality, spans
from tests.llm.fixtures import INNER, SF, clashing, docs, labels, prose

ROWS = [(i, prose(i, 60) + " " + prose(1000 + i % 3, 60), "en" if i % 2 else "de", f"s{i % 3}") for i in range(40)] + [(5, prose(5, 60) + " " + prose(1002, 60), "de", "s2"), (90, None, None, None)]
MARKS = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(40)]
MINE = tuple(f"{name}=mine" for name in INNER)


def values(df):
    return {tuple(r) for r in df.select(*(F.col(f"`{c}`") for c in INNER)).collect()}


#: Operators that return their table with columns more: each as a function of (spark, docs).
KEEPING = {
    "op1": lambda s, d: pieces.encode(d, pieces.vocabulary()),
    "op2": lambda s, d: spans.deduplicated(d),
    "op6": lambda s, d: mixing.repeated(d),
    "op8": lambda s, d: neardup.deduplicated(d),
    "op9": lambda s, d: licences.find(d, licences.train(d)),
    "op10": lambda s, d: quality.score(d, quality.train(d, labels(s, MARKS))),
}


@pytest.mark.parametrize("name", KEEPING)
def test_clashing_columns_keep_their_values(spark, name):
    got = KEEPING[name](spark, clashing(docs(spark, ROWS)))
    assert values(got) == {MINE}
    plain = KEEPING[name](spark, docs(spark, ROWS))
    assert sorted(str(r) for r in got.select(*plain.columns).collect()) == sorted(str(r) for r in plain.collect())


def test_operators_that_return_tables_of_their_own(spark):
    given, plain = clashing(docs(spark, ROWS)), docs(spark, ROWS)
    for run in (mixing.mixed, neardup.grouped, divergence.audit):
        rows = lambda df: sorted(str(r) for r in df.collect())
        assert rows(run(given)) == rows(run(plain))


@pytest.mark.parametrize("stage", range(4))
def test_clashing_columns_through_the_stages(spark, stage, tmp_path):
    labels(spark, MARKS).write.parquet(f"{tmp_path}/labels.parquet")
    given = clashing(docs(spark, ROWS))
    got = corpus_pipeline.STAGES[stage][1](spark, given, str(tmp_path))
    assert got.columns == given.columns and values(got) == {MINE}


@pytest.mark.parametrize("name", ["op1", "op2", "op6", "op8"])
def test_text_keys_tell_rows_like_numbers(spark, name):
    """Keys of text are told by their hash: the same texts come out, whatever the kind of the key."""
    given = docs(spark, ROWS)
    texts = given.withColumn("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    got = KEEPING[name](spark, texts)
    assert got.schema["doc_id"].dataType.simpleString() == "string"
    if name in ("op1", "op2"):
        assert got.count() == len(ROWS)
    if name == "op8":
        assert got.count() == KEEPING[name](spark, given).count()


def test_text_keys_in_groups(spark):
    given = docs(spark, ROWS)
    texts = given.withColumn("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    sizes = lambda df: sorted(r["count"] for r in df.groupBy("component_id").count().collect())
    assert sizes(neardup.grouped(texts)) == sizes(neardup.grouped(given))
    assert sorted(r["taken"] for r in mixing.mixed(texts).collect())
