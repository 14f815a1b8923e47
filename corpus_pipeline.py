"""From raw documents to token ids: five stages, each over all that the one before kept.

Each stage gets (spark, docs, sf_dir), docs being the table that the stage before wrote, and returns a DataFrame. All but
the last return the columns of documents, whatever their names. Texts of any length are taken whole, any column may be null,
and no rows give no rows; what each stage makes of null and empty texts and of repeated rows stands with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import mixing, neardup, pieces, quality, spans
from parlance.llm.common import forget, fresh, keep, table


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, trained on the labels, scores 0.5 or more. Null and empty texts have one
    score and stay or go together; equal texts too."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    x = fresh(docs, "score", "predicted")
    return quality.score(docs, model, names=(x.score, x.predicted)).where(F.col(x.predicted) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 80 per cent): the one with the least key. Rows that
    repeat key and text count once; documents without words (null, empty, blank) all stay."""
    return neardup.deduplicated(docs, k=5, percent=80)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document or place has; n_chars follows the text. A document that is
    left without text stays as a row: the mix never takes it. Null and empty texts stay as they are; of rows that repeat key
    and text one stays whole."""
    cut = spans.deduplicated(docs, count=fresh(docs, "removed").removed)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*(F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Null and empty texts, which have no words, are never taken; a
    null source is one of its own; rows that repeat key and text draw each for itself."""
    return mixing.repeated(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, tokens, n_tokens and lossless of each document taken. Null texts have null tokens, empty ones none; rows that
    repeat key and text have the same tokens."""
    return pieces.encode(docs.select("doc_id", "text"), pieces.vocabulary()).drop("text")


STAGES = [
    ("quality classifier", reject_bad),
    ("minhash near-dedup", one_of_each),
    ("substring dedup", cut_passages),
    ("source mixing", mix_sources),
    ("sentencepiece encoding", encode_pieces),
]

#: Dictionaries, sketches and merges have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs)
            if last is not None:
                forget(last)
            last = docs
    return docs
