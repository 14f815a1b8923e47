"""Word counts, entity tallies and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as X
from parlance.operators import scorers

#: Frequent function words by language, written for this library.
STOPWORDS = {
    "en": "a an and are as at be by for from has he in is it of on or she that the this to was what will with".split(),
    "de": "als auch auf aus bei das dem den der des die ein eine er es für im in ist mit nicht sich sie und von zu".split(),
    "fr": "au avec ce dans de des du elle en est et il la le les ne pas pour que qui se sur un une".split(),
    "es": "al con de del el en es ese la las lo los no para por que se su un una y".split(),
}
TOP = 30
LEAST_SCORE, LEAST_LENGTH = 0.3, 3


def stopwords(spark) -> DataFrame:
    return spark.createDataFrame([(k, w) for k, ws in STOPWORDS.items() for w in ws], "lang string, word string")


def tokens(docs: DataFrame) -> DataFrame:
    """(file_id, lang, pos, word): words of letters only, in lower case but for Arabic."""
    pieces = docs.select("file_id", "lang", F.posexplode(X.split_words(F.col("text"))).alias("pos", "word"))
    letters = pieces.where(F.col("word").rlike(r"\A\p{L}+\z"))
    return letters.withColumn("word", F.when(F.col("lang") == "ar", F.col("word")).otherwise(F.lower("word")))


def without_stopwords(words: DataFrame, stop: DataFrame) -> DataFrame:
    """words that are no stop words of their language; Arabic has none."""
    listed = F.broadcast(stop.where("lang <> 'ar'"))  # a few dozen words a language
    return words.join(listed, ["lang", "word"], "left_anti")


def nouns(words: DataFrame, tagged: DataFrame) -> DataFrame:
    """words that occur anywhere in their file as a noun, by a table (file_id, word, pos_tag)."""
    return words.join(tagged.where("pos_tag = 'NOUN'").select("file_id", "word").distinct(), ["file_id", "word"], "left_semi")


def word_counts(words: DataFrame) -> DataFrame:
    return words.groupBy("file_id", "word").agg(F.count("*").alias("frequency"), F.min("pos").cast("long").alias("first_pos"))


def top_words(counts: DataFrame, n: int = TOP) -> DataFrame:
    """The n most frequent words a file, earlier first occurrence first among equals."""
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("frequency"), "first_pos"))
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def cloud_weights(top: DataFrame) -> DataFrame:
    """Relative frequencies, 1 for the most frequent word of a file."""
    return top.withColumn("weight", F.col("frequency") / F.max("frequency").over(Window.partitionBy("file_id")))


def entities(found: DataFrame) -> DataFrame:
    """Entities with text and label, three characters or more, and a score of 0.3 or more; a bad score counts as 0."""
    score = F.coalesce(F.col("score").cast("string").try_cast("double"), F.lit(0.0))
    fine = ~X.is_blank(F.col("text")) & ~X.is_blank(F.col("label")) & (F.length(X.strip(F.col("text"))) >= LEAST_LENGTH) & (score >= LEAST_SCORE)
    return found.where(fine)


def entity_tally(found: DataFrame) -> DataFrame:
    """(file_id, category, entity, frequency, rank): counts by upper-case label and text, in order of first occurrence."""
    made = found.groupBy("file_id", F.upper(X.strip(F.col("label"))).alias("category"), X.strip(F.col("text")).alias("entity"))
    made = made.agg(F.count("*").alias("frequency"), F.min("pos").alias("first_pos"))
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy("first_pos", "category"))
    return made.select("file_id", "category", "entity", "frequency", rank.cast("long").alias("rank"))


def recognised(texts: DataFrame, scorer: scorers.Scorer, budget: int = 512) -> DataFrame:
    """(file_id, pos, text, label, score): entities of texts (file_id, text), from a scorer of chunks that replies with a JSON
    list; a chunk whose call fails, or whose reply is no list, is left out, and the others count."""
    chunks = texts.select("file_id", F.posexplode(X.entity_chunks(F.col("text"), budget, whole=True)).alias("chunk_pos", "chunk"))
    read = F.from_json("reply", "array<struct<text:string,label:string,score:double>>")
    each = scorers.attempted(chunks, "chunk", scorer).where("not failed").select("file_id", "chunk_pos", F.posexplode(read).alias("i", "e"))
    return each.select("file_id", (F.col("chunk_pos").cast("long") * 100_000 + F.col("i")).alias("pos"), "e.text", "e.label", "e.score")


def findings(rows: DataFrame, by: str = "row_idx") -> DataFrame:
    """Flagged rows before the first one of their file that failed (ok = false): a sweep that stops at an outage."""
    failed = F.min(F.when(~F.col("ok"), F.col(by))).over(Window.partitionBy("file_id"))
    return rows.withColumn("stop", failed).where((F.col("stop").isNull() | (F.col(by) < F.col("stop"))) & F.col("detection.hate_speech")).drop("stop")
