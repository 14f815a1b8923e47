"""Small awkward tables for the corpus operators."""

import random

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in "ba de fi go lu ma ne pi ro su ta ve".split() for b in "lan mir ton sek vor nud ras".split()]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, tokens string, node string, place string, size string, bucket string, label string, removed_words string, copies string, `families` string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append(r.choice(WORDS) + ("." if i % 9 == 8 else ""))
    return " ".join(out)


def awkward():
    """(doc_id, text, lang, source): nulls in every column, empty, blank, long and odd texts, ties and repeated rows."""
    base = prose(1, 120)
    rows = [
        (1, base, "en", "web"), (2, base, "en", "web"), (2, base, "en", "web"), (3, base.replace("lan", "LAN"), "en", None),
        (4, base + " one more word", None, "web"), (5, None, "en", "books"), (6, "", "en", "books"), (7, " \n\t ", "de", "books"),
        (8, "word", "de", "wiki"), (9, "two words", "de", "wiki"), (10, "12 34 !?", "de", None), (None, base, "en", "web"),
        (None, None, None, None), (None, prose(2, 40), "de", "wiki"), (11, "naïve Ünïcødé 漢字かな 😀 \u0000 end", "fr", "wiki"),
        (12, prose(3, 60000), "fr", "web"), (13, "x" * 50000, "fr", "web"), (14, prose(4, 80) + "\n" + base, "en", "books"), (15, "two words", "de", "wiki"),
    ]
    return rows


#: Names that operators have used within themselves.
INNER = "__key __hash __k __later __own __draw __text __place __score __turn __removed __part __n row key hash draw text_ out".split()


def clashing(df):
    """df with columns named like those that operators use within, each with a value of its own."""
    for name in INNER:
        df = df.withColumn(name, F.concat(F.lit(name), F.lit("=mine")))
    return df


def docs(spark, rows=None):
    rows = awkward() if rows is None else rows
    df = spark.createDataFrame([(i, t, a, s, None if t is None else len(t)) for i, t, a, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("score", "predicted", "tokens", "node", "place", "size", "bucket", "label", "removed_words", "copies", "families"):
        df = df.withColumn(extra, F.lit("mine"))
    return df


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
