"""Context-triggered piecewise hashing: a rolling hash cuts a text into pieces, each piece gives one character."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cuts, whole_number
from .words import Prefix, U

WINDOW = 7
LEAST_BLOCK = 4
MOST = 64
#: Bytes of text that a range of documents holds about, rows that are sampled to find the ranges, at least and at most, and
#: sampled rows a range at least.
RANGE, SAMPLE, A_RANGE = 16 << 20, (5_000, 500_000), 20
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
SLICE = 1 << 20


class Signatures(NamedTuple):
    """Of n texts: block sizes, and characters (0-63) and lengths of the signatures at that block size and at twice it."""

    block: np.ndarray
    fine: np.ndarray
    fine_n: np.ndarray
    coarse: np.ndarray
    coarse_n: np.ndarray

    def take(self, rows) -> Signatures:
        return Signatures(*(x[rows] for x in self))

    def strings(self) -> list[str]:
        text = lambda row, n: ALPHABET[row[:n]].tobytes().decode()
        return [f"{b}:{text(f, m)}:{text(c, n)}" for b, f, m, c, n in zip(self.block.tolist(), self.fine, self.fine_n.tolist(), self.coarse, self.coarse_n.tolist(), strict=True)]


def rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the WINDOW bytes that end at each place."""
    x = data.astype(np.uint32) + np.uint32(1)
    h = np.zeros(len(x), np.uint32)
    for k in range(WINDOW):
        h[k:] += x[: len(x) - k] * np.uint32(pow(0x01000193, k + 1, 1 << 32))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def signatures(texts: list[bytes]) -> Signatures:
    """Of whole texts. The block size is the least power of two from LEAST_BLOCK on that leaves MOST pieces at most, by
    length; it is halved as long as that gives less than a quarter of MOST. Pieces beyond MOST count as one, the last."""
    n = len(texts)
    out = Signatures(np.full(n, LEAST_BLOCK, np.int64), np.zeros((n, MOST), np.uint8), np.zeros(n, np.int64), np.zeros((n, MOST), np.uint8), np.zeros(n, np.int64))
    i = 0
    while i < n:
        j, size = i, 0
        while j < n and (j == i or size + len(texts[j]) <= SLICE):
            size += len(texts[j])
            j += 1
        data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts[i:j]])])
        _slice(data, off, out, i)
        i = j
    return out


def _slice(data: np.ndarray, off: np.ndarray, out: Signatures, first: int) -> None:
    h = rolling(data)
    piece = Prefix(data.astype(U) + U(1))
    zero = h & np.uint32(LEAST_BLOCK - 1)
    ends = np.flatnonzero(zero == 0)
    marks = h[ends]
    at = np.searchsorted(ends, off)
    starts, stops, rows, kinds = [], [], [], []
    for d in range(len(off) - 1):
        a, b = int(off[d]), int(off[d + 1])
        if a == b:
            continue
        mine, level = ends[at[d] : at[d + 1]], marks[at[d] : at[d + 1]]
        full = mine >= a + WINDOW - 1
        mine, level = mine[full], level[full]
        block = LEAST_BLOCK
        while block * MOST < b - a:
            block *= 2
        cut = mine[(level & np.uint32(block - 1)) == 0]
        while cut.size < MOST // 4 and block > LEAST_BLOCK:
            block //= 2
            cut = mine[(level & np.uint32(block - 1)) == 0]
        out.block[first + d] = block
        for kind, c in ((0, cut), (1, mine[(level & np.uint32(2 * block - 1)) == 0])):
            e = c[: MOST - 1] + 1
            if not e.size or e[-1] != b:
                e = np.append(e, b)
            starts.append(np.concatenate([[a], e[:-1]]))
            stops.append(e)
            rows.append(first + d)
            kinds.append(kind)
    if not starts:
        return
    code = (piece(np.concatenate(starts), np.concatenate(stops)) >> U(58)).astype(np.uint8)
    k = 0
    for row, kind, e in zip(rows, kinds, stops, strict=True):
        chars, many = (out.fine, out.fine_n) if kind == 0 else (out.coarse, out.coarse_n)
        chars[row, : len(e)] = code[k : k + len(e)]
        many[row] = len(e)
        k += len(e)


def distance(a: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_n: np.ndarray) -> np.ndarray:
    """Edit distances of rows of a and b, 64 characters at most, all pairs at once by bit vectors."""
    n = len(a)
    where = np.arange(n)
    has = np.zeros((n, MOST), U)
    for i in range(int(a_n.max(initial=0))):
        on = where[a_n > i]
        has[on, a[on, i]] |= U(1 << i)
    up, down, dist = np.full(n, ~U(0)), np.zeros(n, U), a_n.astype(np.int64).copy()
    last = np.maximum(a_n - 1, 0).astype(U)
    for j in range(int(b_n.max(initial=0))):
        eq = has[where, b[:, j]]
        live = b_n > j
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up), up & xh
        dist += np.where(live, ((ph >> last) & U(1)).astype(np.int64) - ((mh >> last) & U(1)).astype(np.int64), 0)
        ph, mh = (ph << U(1)) | U(1), mh << U(1)
        up, down = np.where(live, mh | ~(xv | ph), up), np.where(live, ph & xv, down)
    return np.where(a_n == 0, b_n, dist)


def likeness(a: Signatures, b: Signatures) -> np.ndarray:
    """1 less the edit distance by the longer signature, at a block size that both have; 0 where there is none."""
    out = np.zeros(len(a.block))
    for on, x, x_n, y, y_n in (
        (a.block == b.block, a.fine, a.fine_n, b.fine, b.fine_n),
        (a.block == 2 * b.block, a.fine, a.fine_n, b.coarse, b.coarse_n),
        (2 * a.block == b.block, a.coarse, a.coarse_n, b.fine, b.fine_n),
    ):
        r = np.flatnonzero(on)
        if len(r):
            most = np.maximum(np.maximum(x_n[r], y_n[r]), 1)
            out[r] = 1 - distance(x[r], x_n[r], y[r], y_n[r]) / most
    return out


def parse(prints: list[str]) -> Signatures:
    """Signatures of fingerprint strings."""
    back = np.zeros(256, np.uint8)
    back[ALPHABET] = np.arange(64)
    out = signatures([b""] * len(prints))
    for i, p in enumerate(prints):
        block, fine, coarse = p.split(":")
        out.block[i] = int(block)
        for text, chars, many in ((fine, out.fine, out.fine_n), (coarse, out.coarse, out.coarse_n)):
            chars[i, : len(text)], many[i] = back[np.frombuffer(text.encode(), np.uint8)], len(text)
    return out


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column; null counts as the empty text."""

    @F.pandas_udf("string")
    def made(column: pd.Series) -> pd.Series:
        return pd.Series(signatures([(t or "").encode() for t in column]).strings())

    return made(text)


def compare(left: Column, right: Column) -> Column:
    """The likeness (0 to 1) of two columns of fingerprints; null if either is."""

    @F.pandas_udf("double")
    def made(a: pd.Series, b: pd.Series) -> pd.Series:
        there = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        if there.any():
            out[there] = likeness(parse(a[there].tolist()), parse(b[there].tolist()))
        return pd.Series(out).astype(object).where(there, None).astype("Float64")

    return made(left, right)


def in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(range, echo, key, text), dealt so that each partition holds a range of the documents in descending order of key
    (nulls last; equal keys by a hash of the text), and after them the first document of the next range, marked echo=1.
    After the last range comes the first.

    Ranges are cut between rows of a sample, by bytes of text, so their number grows with the bytes and rows that share a
    key, or have none, are dealt by their text. Rows that repeat key and text are alike in all that matters here; they share
    a range, where they are sorted and read one after the other."""
    spark = docs.sparkSession
    # ascending order: the complement of the key, then the hash; nulls last
    placed = docs.select(whole_number(docs, key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("hash"))
    placed = placed.withColumn("order", F.coalesce(F.bitwise_not("key"), F.lit((1 << 63) - 1)))
    many = docs.count()
    wanted = min(max(many // 200, SAMPLE[0]), SAMPLE[1])
    share = min(1.0, wanted / max(1, many))
    some = placed.where(F.pmod(F.xxhash64("order", "hash", F.lit(7)), F.lit(1_000_000)) < max(1, int(share * 1_000_000)))
    some = some.select("order", "hash", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).toPandas().sort_values(["order", "hash"])
    size = (some["bytes"].to_numpy() + 64).cumsum()
    total = size[-1] / share if len(size) else 0
    n = int(min(max(-(-total // RANGE), int(spark.conf.get("spark.sql.shuffle.partitions"))), max(1, len(size) // A_RANGE)))
    at = np.unique(np.searchsorted(size, np.arange(1, n) * (size[-1] if len(size) else 0) / n))
    edges = some[["order", "hash"]].iloc[at].drop_duplicates().to_numpy()
    orders, hashes = edges[:, 0].astype(np.int64), edges[:, 1].astype(np.int64)

    @F.pandas_udf("int")
    def range_of(order: pd.Series, hash: pd.Series) -> pd.Series:
        """How many edges of ranges are not after a row."""
        o, h = order.to_numpy(), hash.to_numpy()
        low, high = np.searchsorted(orders, o, side="left"), np.searchsorted(orders, o, side="right")
        for a in np.unique(low[low < high]):
            here = np.flatnonzero((low == a) & (low < high))
            low[here] = a + np.searchsorted(hashes[a : high[here[0]]], h[here], side="right")
        return pd.Series(low.astype(np.int32))

    placed = placed.withColumn("range", range_of("order", "hash"))
    tops = placed.groupBy("range").agg(F.min(F.struct("order", "hash")).alias("top")).select("range", "top.*").toPandas().sort_values("range")  # a row a range
    ranges = tops["range"].tolist()
    firsts = list(zip(ranges[-1:] + ranges[:-1], tops["order"].tolist(), tops["hash"].tolist(), strict=True))
    first = spark.createDataFrame(firsts, "before int, t_order long, t_hash long")
    met = docs.select(whole_number(docs, key).alias("key"), F.col(text).alias("text")).withColumn("hash", F.xxhash64("text")).withColumn("order", F.coalesce(F.bitwise_not("key"), F.lit((1 << 63) - 1)))
    met = met.join(F.broadcast(first), (F.col("order") == F.col("t_order")) & (F.col("hash") == F.col("t_hash")))
    echoes = met.groupBy(F.col("before").alias("range"), "order", "hash").agg(F.first("key").alias("key"), F.first("text").alias("text"))
    every = placed.withColumn("echo", F.lit(0)).unionByName(echoes.withColumn("echo", F.lit(1)))
    dealt = every.repartitionById(len(edges) + 1, F.col("range")).sortWithinPartitions("range", "echo", "order", "hash")
    return dealt.select("range", "echo", "key", "text")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third (floor of code points by 3) replaced by the first as many code points of the next
    document in descending order of key; after the last comes the first, and a single document follows itself. Null text
    counts as empty. Rows with equal or null keys are each a document of their own, ordered by a hash of their text. Texts of
    any length are taken whole; other columns do not come along. No rows give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for i, j in cuts([batch.column(3)], 4 << 20):
                part = batch.slice(i, j - i)
                rows = held + list(zip(*(part.column(k).to_pylist() for k in range(4)), strict=True))
                held = rows[-1:]
                yield made(rows)
        # a range ends with an echo, so no document is held at the end

    def made(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[3] or "" for r in rows]
        use = [i for i in range(len(rows) - 1) if not rows[i][1]]  # each is followed by a row of its bucket
        raw = [t.encode() for t in texts]
        plain = signatures(raw)
        edited = []
        for i in use:
            t, k = texts[i], len(texts[i]) // 3
            edited.append((t[: len(t) - k] + texts[i + 1][:k]).encode() if k else raw[i])
        changed = signatures(edited)
        mine = np.array(use, np.int64)
        ids = pa.array([rows[i][2] for i in use], pa.int64())
        cols = [ids, pa.array([len(texts[i]) for i in use], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string())]
        cols += [pa.array(plain.take(mine).strings(), pa.string()), pa.array(changed.strings(), pa.string())]
        cols += [pa.array(likeness(plain.take(mine), changed)), pa.array(likeness(plain.take(mine), plain.take(mine + 1)))]
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(n, T.StringType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next")]
    )
    return in_order(docs, key, text).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return with_next(table(spark, sf_dir, "documents"))
