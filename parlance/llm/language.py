"""Language by nearest centroid: normalised TF-IDF vectors of character trigrams, several centroids a language."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, keep, remainder, small
from .words import slices

DIMS = 4096
CENTROIDS = 3
SAMPLE_DOCS = 2400
REJECT_QUANTILE = 0.002
FOLD, HELD = 4, 2
LETTER = re.compile(r"[^\W\d_]")


def _fold_bytes() -> np.ndarray:
    """Lower case for A-Z and for the Latin letters of two bytes that begin with 0xC3; all white space and ASCII that is no
    letter counts as one blank."""
    t = np.full(256, 32, np.uint8)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


_FOLD = _fold_bytes()


def buckets(data: np.ndarray) -> np.ndarray:
    """The feature of each run of three bytes: a hashed bucket below DIMS."""
    b = _FOLD[data]
    upper = np.zeros(len(b), bool)
    upper[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)
    b = np.where(upper, b + 32, b).astype(np.uint32)
    code = b[:-2] | b[1:-1] << 8 | b[2:] << 16 if len(b) > 2 else np.zeros(0, np.uint32)
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)


def counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of feature counts for each text; runs that cross from one text into the next count for none."""
    out = np.zeros((len(off) - 1, DIMS), np.float32)
    every = buckets(data)
    for i in range(len(off) - 1):
        if off[i + 1] - off[i] >= 3:
            out[i] = np.bincount(every[off[i] : off[i + 1] - 2], minlength=DIMS)
    return out


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def parts(column: pa.Array, rows: int = 256):
    """(first row, bytes, offsets) of up to `rows` texts, and about a megabyte of text, at a time; one text at least."""
    for first, data, off in slices(column):
        for i in range(0, len(off) - 1, rows):
            j = min(i + rows, len(off) - 1)
            yield first + i, data[off[i] : off[j]], off[i : j + 1] - off[i]


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of the one column each feature occurs, and the number of texts: one row a task and feature, then a sum."""

    def run(batches):
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for _, data, off in parts(batch.column(0)):
                df += (counts(data, off) > 0).sum(0)
                n += len(off) - 1
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(df[there], n))], names=["feature", "n"])

    rows = texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # DIMS + 1 rows at most
    df, n = np.zeros(DIMS), 0
    for r in rows:
        if r["feature"] < 0:
            n = r["n"]
        else:
            df[r["feature"]] = r["n"]
    return df, n


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean's nearest row, each next one the row least like those so far."""
    centres = [x[np.argmax(x @ x.mean(0))]]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[np.argmin((x @ np.array(centres).T).max(1))])
    c = np.array(centres)
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.array([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray, radius: np.ndarray):
        self.idf, self.langs, self.centres, self.radius = idf.astype(np.float32), langs, centres.astype(np.float32), radius


def train(docs: DataFrame, fold: int = FOLD, held: int = HELD) -> Model:
    """Document frequencies of all rows outside the held-out remainder; centroids of at most SAMPLE_DOCS of them (three a
    language at least), chosen by hash, as many for each language at most; equal texts of a language count once. A radius a
    centroid holds all but REJECT_QUANTILE of its own texts."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("doc_id"), fold) != held))
    df, n = document_frequencies(rows.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1.0
    many = keep(rows.groupBy("lang").agg(F.count("*").alias("n")))
    spoken = many.count()
    if not spoken:
        return Model(idf, [], np.zeros((0, DIMS)), np.zeros(0))
    each = max(CENTROIDS, SAMPLE_DOCS // spoken)
    draw = F.xxhash64("text", F.lit(9))
    shares = many.select("lang", F.least(F.lit(1_000_000), F.ceil(F.lit(1_200_000.0 * each) / F.col("n"))).alias("share"))
    picked = rows.join(small(shares), "lang").where(F.pmod(draw, F.lit(1_000_000)) < F.col("share"))
    picked = picked.groupBy("lang", draw.alias("draw")).agg(F.first("text").alias("text"))
    picked = picked.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("place") <= each)

    def run(batches):
        for batch in batches:
            for i, data, off in parts(batch.column(0)):
                x = vectors(counts(data, off), idf.astype(np.float32)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, len(x)), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "vec"])

    got = picked.select("text", "lang").mapInArrow(run, "lang string, vec binary").toPandas()  # `each` rows a language at most
    langs, centres, radius = [], [], []
    for lang, own in got.groupby("lang"):
        x = np.array([np.frombuffer(v, np.float16) for v in sorted(own["vec"])], np.float32).reshape(-1, DIMS)
        x = x[(x != 0).any(1)]
        if not len(x):
            continue
        c = cluster(x, CENTROIDS)
        near = (x @ c.T).max(1)
        langs += [lang] * len(c)
        centres += list(c)
        radius += [float(np.quantile(near, REJECT_QUANTILE))] * len(c)
    return Model(idf, langs, np.array(centres).reshape(-1, DIMS), np.array(radius))


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def predict(docs: DataFrame, model: Model, text: str = "text", reject: bool = False) -> DataFrame:
    """docs with lang_pred, score (the cosine to the nearest centroid) and rejected: true beyond that centroid's radius.

    Null texts and texts without a letter give `und`, 0 and true; so does every text if nothing was learned. A text with
    letters but no known feature takes the first language by name with score 0, rejected. reject=True turns rejected
    predictions into `und`. Columns of those names are replaced; ties go to the first language by name. Whole texts of any
    length count; equal texts, and so repeated rows, are predicted alike. No rows give no rows."""

    def make(texts: pa.Array) -> list[pa.Array]:
        best, score = np.zeros(len(texts), int), np.zeros(len(texts))
        letters = np.array([bool(t) and LETTER.search(t) is not None for t in texts.to_pylist()], bool)
        if len(model.langs):
            for i, data, off in parts(texts):
                s = vectors(counts(data, off), model.idf) @ model.centres.T
                best[i : i + len(s)], score[i : i + len(s)] = s.argmax(1), s.max(1)
        known = letters & bool(len(model.langs))
        out = ~known | (score < (model.radius[best] if len(model.langs) else 0))
        names = [model.langs[b] if k and not (reject and o) else "und" for b, k, o in zip(best, known, out, strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0)), pa.array(out)]

    return append(docs, [text], FIELDS, make)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), FOLD) == HELD).alias("held_out"), "lang_pred", "score", "rejected")
