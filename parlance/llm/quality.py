"""Quality by compression: zstandard dictionaries of good and of bad text, and the difference that they make."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, forget, keep, labelled_texts, logistic, remainder, sigmoid

BLOCK = 1024
DICT_BYTES = 32768
SAMPLE_DOCS = 12000
SAMPLE_BLOCKS = 3000
FOLD, HELD = 3, 1


def cut(data: bytes) -> list[bytes]:
    """A whole text's blocks; the empty text has one empty block."""
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]


class Compressors:
    """The two dictionaries, prepared once a task."""

    def __init__(self, good: bytes, bad: bytes, level: int = 3):
        self.both = []
        for d in (good, bad):
            known = zstandard.ZstdCompressionDict(d)
            known.precompute_compress(level=level)
            self.both.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False))

    def features(self, data: bytes) -> tuple[float, float, float]:
        """Normalised size difference (above 0: the good dictionary fits better), size by the good one per byte, log length."""
        good, bad = (sum(len(c.compress(b)) for b in cut(data)) for c in self.both)
        return (bad - good) / max(good, bad), good / (len(data) + 16), float(np.log1p(len(data)))


def all_features(use: Compressors, texts: pa.Array) -> np.ndarray:
    return np.array([use.features((t or "").encode()) for t in texts.to_pylist()], float).reshape(-1, 3)


def _shape(f: np.ndarray) -> np.ndarray:
    """What the calibration sees: the difference alone, damped for short texts, and the two sizes that it is set against."""
    trust = np.minimum(f[:, 2], 8.0) / 8.0
    return np.column_stack([10 * f[:, 0], 10 * f[:, 0] * trust, f[:, 1], f[:, 2] / 8.0])


def train(docs: DataFrame, labels: DataFrame, fold: int = FOLD, held: int = HELD) -> tuple[bytes, bytes, list[float]]:
    """Dictionaries and calibration weights, from at most SAMPLE_DOCS labelled rows (all other rows have no say).

    Two thirds of the sample give blocks for the dictionaries, at most SAMPLE_BLOCKS of BLOCK bytes a class, chosen by
    hash over whole texts; the last third calibrates. Of texts that share a doc_id the least counts. With one class only,
    the score is that class's share."""
    rows = keep(labelled_texts(docs, labels, "quality", fold, held, SAMPLE_DOCS).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3))))
    sizes = {r["y"]: r["n"] for r in rows.where("part < 2").groupBy("y").agg(F.sum(F.ceil((F.octet_length("text") + 1) / BLOCK)).alias("n")).collect()}

    def take(batches):
        for batch in batches:
            out = [(y, b) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for b in cut(t.encode()) if share_of(b) < SAMPLE_BLOCKS / max(1, sizes[y])]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["y", "block"])

    got = rows.where("part < 2").select("text", "y").mapInArrow(take, "y int, block binary").toPandas()
    made = []
    for y in (1, 0):
        some = sorted({bytes(b) for b in got["block"][got["y"] == y]}, key=lambda b: (share_of(b), b))[:SAMPLE_BLOCKS]
        made.append(dictionary(some))
    good, bad = made
    tuned = append(rows.where("part = 2").select("text", "y"), ["text"], [T.StructField(n, T.DoubleType()) for n in "abc"], measure(good, bad)).select("y", "a", "b", "c").toPandas()
    y = tuned["y"].to_numpy(float)
    forget(rows)
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return good, bad, [0.0, 0.0, 0.0, 0.0, float(np.log((share + 0.01) / (1.01 - share)))]
    return good, bad, [float(v) for v in logistic(_shape(tuned[["a", "b", "c"]].to_numpy()), y)]


def share_of(block: bytes) -> float:
    """A number from 0 to 1 that depends on the block alone."""
    import xxhash

    return xxhash.xxh64_intdigest(block, 11) / 2**64


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; with too few to train one, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICT_BYTES:].ljust(8, b" ")


def measure(good: bytes, bad: bytes):
    kept: list[Compressors] = []

    def make(texts: pa.Array) -> list[pa.Array]:
        if not kept:
            kept.append(Compressors(good, bad))
        f = all_features(kept[0], texts)
        return [pa.array(f[:, k]) for k in range(3)]

    return make


def score(docs: DataFrame, model: tuple[bytes, bytes, list[float]], text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score double (0 to 1, higher: better) and predicted int; null or empty text is scored as the empty text.

    Columns of these two names, which `names` sets, are replaced. Whole texts of any length are compressed, block by block.
    Equal texts, and so repeated rows, score equally; 0.5 counts as good; row order has no effect. No rows give no rows."""
    good, bad, w = model
    kept: list[Compressors] = []

    def make(texts: pa.Array) -> list[pa.Array]:
        if not kept:
            kept.append(Compressors(good, bad))
        f = all_features(kept[0], texts)
        p = sigmoid(np.column_stack([_shape(f), np.ones(len(f))]) @ np.array(w))
        return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

    return append(docs, [text], [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())], make)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLD) == HELD).alias("held_out"), "score", "predicted")
