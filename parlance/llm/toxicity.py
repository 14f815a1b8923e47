"""Toxicity by a factorization machine over hashed terms: weights of single terms plus products of pairs of terms."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, labelled_texts, logistic, remainder, sigmoid
from .words import U, bare, scan, slices

#: Every term has one of 2**BITS weights and vectors by its hash; none is left out.
BITS = 17
STEM = 4
MIX = 0x9E3779B97F4A7C15
SAMPLE_DOCS = 8000
#: Machines that are averaged, each fitted to all parts of the sample but one, and the rank of each.
PARTS, RANK = 3, 3
#: Rows a step (fewer of a small sample, for fifty steps a round), rounds, and rounds without a gain after which the fit ends.
BATCH, ROUNDS, PATIENCE = 256, 12, 4
#: Step size, and decay of single weights and of vectors.
RATE, DECAY = 0.3, (3e-5, 6e-3)
#: A text of n terms has each to the extent of SPREAD / sqrt(n + SHORT).
SPREAD, SHORT = 4.0, 32.0
FOLD, HELD = 5, 0


class Terms(NamedTuple):
    """The distinct hashed terms of texts, one text after the other, and the n+1 offsets of the texts."""

    at: np.ndarray
    off: np.ndarray


def terms(column: pa.Array) -> Iterator[tuple[int, Terms]]:
    """(first row, terms) of slices of whole texts. A term is a word without ASCII punctuation at its ends, A-Z taken as
    a-z, or the first STEM bytes of a longer one; words of punctuation only are no terms. How often a text has a term
    makes no difference."""
    for first, data, off in slices(column):
        w = scan(data, off, hashes=False)
        rows = np.repeat(np.arange(len(off) - 1), np.diff(w.of))
        both = [rows[h != 0] << BITS | ((h[h != 0] + U(k)) * U(MIX) >> U(64 - BITS)).astype(np.int64) for k, h in enumerate(bare(w, STEM))]
        both = np.unique(np.concatenate(both))
        yield first, Terms(both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(len(off))))


def sums(rows: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of the rows of each stretch between offsets; zeros for an empty one."""
    out = np.zeros((len(off) - 1, rows.shape[1]), rows.dtype)
    some = np.diff(off) > 0
    if some.any():
        out[some] = np.add.reduceat(rows, off[:-1][some], axis=0)
    return out


def extent(x: Terms) -> np.ndarray:
    """To what extent a text has each of its terms: less, the more there are."""
    return (SPREAD / np.sqrt(np.diff(x.off) + SHORT)).astype(np.float32)


class Machine:
    """w0 + sum of w over a text's terms + sum over pairs of them of <v, v'>, by the extent that it has them, as a
    calibrated probability."""

    def __init__(self, w0: float, p: np.ndarray, scale: tuple[float, float] = (1.0, 0.0)):
        self.w0, self.p, self.scale = w0, p.astype(np.float32), scale

    def raw(self, x: Terms) -> np.ndarray:
        # the sum over pairs is half of |sum of v| squared less the sum of |v| squared
        own, e = self.p[x.at], extent(x)
        s = sums(np.column_stack([own, (own[:, 1:] ** 2).sum(1)]), x.off)
        return self.w0 + e * s[:, 0] + 0.5 * e * e * ((s[:, 1:-1] ** 2).sum(1) - s[:, -1])

    def __call__(self, x: Terms) -> np.ndarray:
        return sigmoid(self.scale[0] * self.raw(x).astype(float) + self.scale[1])


def taken(x: Terms, rows: np.ndarray) -> Terms:
    """The terms of some texts."""
    many = np.diff(x.off)[rows]
    off = np.concatenate([[0], np.cumsum(many)])
    return Terms(x.at[np.repeat(x.off[:-1][rows] - off[:-1], many) + np.arange(off[-1])], off)


def loss(raw: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -raw, raw)).mean()) if len(y) else 0.0


def fit(x: Terms, y: np.ndarray, test: Terms, test_y: np.ndarray, rank: int = RANK, rounds: int = ROUNDS, seed: int = 3) -> Machine:
    """The machine's weights by gradient steps with momentum over mini-batches of the logistic loss, with L2 on all but
    the constant; of all rounds the weights with the least loss on the test rows."""
    rng = np.random.default_rng(seed)
    n, d = len(y), 1 << BITS
    w0 = float(np.log((y.mean() + 1e-3) / (1.001 - y.mean())))
    p = np.column_stack([np.zeros(d), rng.normal(0, 0.05, (d, rank))]).astype(np.float32)
    decay = np.array([DECAY[0]] + [DECAY[1]] * rank, np.float32)
    size = max(16, min(BATCH, n // 50))
    shuffled = rng.permutation(n)
    batches = []
    for i in range(0, n, size):
        rows = shuffled[i : i + size]
        b = taken(x, rows)
        order = np.argsort(b.at, kind="stable")
        there, first = np.unique(b.at[order], return_index=True)
        batches.append((b, y[rows], extent(b), np.repeat(np.arange(len(rows)), np.diff(b.off)), order, there, first))
    best, least, since = Machine(w0, p), np.inf, 0
    move = np.zeros_like(p)
    for _ in range(rounds):
        for i in rng.permutation(len(batches)):
            b, yb, e, row, order, there, first = batches[i]
            own = p[b.at]
            s = sums(np.column_stack([own, (own[:, 1:] ** 2).sum(1)]), b.off)
            raw = w0 + e * s[:, 0] + 0.5 * e * e * ((s[:, 1:-1] ** 2).sum(1) - s[:, -1])
            off_by = ((sigmoid(raw) - yb) / len(yb)).astype(np.float32)
            g = np.empty_like(own)
            g[:, 0] = (off_by * e)[row]
            g[:, 1:] = (off_by * e * e)[row, None] * (s[row, 1:-1] - own[:, 1:])
            move *= np.float32(0.9)
            move += decay * p
            if len(there):
                move[there] += np.add.reduceat(g[order], first, axis=0)
            p -= np.float32(RATE) * move
            w0 -= 4 * float(off_by.sum())  # faster than the terms, which would share the constant among them
        made = Machine(w0, p.copy())
        now = loss(made.raw(test), test_y)
        since = 0 if now < least else since + 1
        if now < least:
            best, least = made, now
        if since == PATIENCE:
            break
    return best


def average(machines: list[Machine]) -> Machine:
    """The machine whose raw score is the mean of theirs: its vectors are theirs side by side."""
    n = len(machines)
    w = sum(m.p[:, 0] for m in machines) / n
    return Machine(sum(m.w0 for m in machines) / n, np.column_stack([w, *(m.p[:, 1:] / np.sqrt(n) for m in machines)]))


def train(docs: DataFrame, labels: DataFrame, fold: int = FOLD, held: int = HELD) -> Machine:
    """A machine learned from at most SAMPLE_DOCS labelled rows, chosen by hash, over all their terms.

    Texts of equal terms and label count once; of texts that share a doc_id the least counts. The sample is dealt to PARTS,
    with as many rows of each label; a task a part fits a machine to the other parts and ends the fit by this one. Their
    mean is the model, calibrated by what each said of its own part. With one label only, or none, the score is that
    label's share."""
    rows = labelled_texts(docs, labels, "toxic", fold, held, SAMPLE_DOCS)

    def run(batches):
        for batch in batches:
            y = batch.column(1).to_numpy()
            for first, x in terms(batch.column(0)):
                sets = [x.at[a:b].astype(np.int32).tobytes() for a, b in zip(x.off[:-1], x.off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), pa.array(y[first : first + len(sets)])], names=["terms", "y"])

    got = rows.select("text", "y").mapInArrow(run, "terms binary, y int").toPandas()  # SAMPLE_DOCS rows at most, of hashes
    got = got.sort_values(["terms", "y"]).drop_duplicates().reset_index(drop=True)
    y = got["y"].to_numpy(float)
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Machine(float(np.log((share + 0.01) / (1.01 - share))), np.zeros((1 << BITS, 1 + RANK)))
    x = Terms(np.frombuffer(b"".join(got["terms"]), np.int32), np.concatenate([[0], np.cumsum(got["terms"].map(len) // 4)]))
    part = np.empty(len(y), np.int64)
    part[np.lexsort([np.random.default_rng(1).random(len(y)), y])] = np.arange(len(y)) % PARTS
    spark = docs.sparkSession
    sample = spark.sparkContext.broadcast((x, y, part))

    def learn(batches):
        x, y, part = sample.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                use, back = np.flatnonzero(part != k), np.flatnonzero(part == k)
                test = taken(x, back)
                made = fit(taken(x, use), y[use], test, y[back])
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([made.w0]), pa.array([made.p.tobytes()], pa.binary()), pa.array([made.raw(test).astype(float).tobytes()], pa.binary())], names=["k", "w0", "p", "raw"])

    learned = spark.range(PARTS, numPartitions=PARTS).mapInArrow(learn, "k long, w0 double, p binary, raw binary").collect()  # PARTS machines
    raw = np.empty(len(y))
    for r in learned:
        raw[part == r["k"]] = np.frombuffer(r["raw"])
    learned = [Machine(r["w0"], np.frombuffer(r["p"], np.float32).reshape(1 << BITS, -1)) for r in sorted(learned, key=lambda r: r["k"])]
    made = average(learned)
    made.scale = tuple(float(a) for a in logistic(raw[:, None], y, l2=0.1))
    return made


FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def score(docs: DataFrame, model: Machine, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: likelier toxic) and predicted (score >= 0.5), of whole texts of any length.

    Null and empty texts have no terms and get the machine's constant; equal texts, and so repeated rows, score equally;
    0.5 counts as toxic. Columns of those names are replaced. No rows give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows of 1 + PARTS * RANK numbers

    def make(texts: pa.Array) -> list[pa.Array]:
        p = np.zeros(len(texts))
        for first, x in terms(texts):
            p[first : first + len(x.off) - 1] = shared.value(x)
        return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

    return append(docs, [text], FIELDS, make)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLD) == HELD).alias("held_out"), "score", "predicted")
