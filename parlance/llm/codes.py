"""Compression of vectors to codes: k-means of their parts in integers, with a VA-file to find nearest entries.

A vector's parts each get the number of the nearest entry of their codebook. Entries are found by filter and refinement: each
coordinate of an entry is quantised to a cell of a few bits, a part's lookup tables of cells give a lower and an upper bound
of its distance to every entry, and only entries whose lower bound does not exceed the least upper bound are compared by
their integer distances. So the result is exact. A round of k-means is one pass: tasks add up their parts by entry, and only
sums (entries times coordinates) leave them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep, small, whole_number
from .neighbours import matrix

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Bits of a cell's number.
CELL_BITS = 4
#: Scaled components beyond this (2^25) count as this, so that sums of squares fit in 64 bits.
MOST = 1 << 25
#: Parts that are searched at once.
AT_ONCE = 2048


class Cells:
    """A VA-file of one codebook (entries, width): of each coordinate its cell, and the cells' edges."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries = entries
        low, reach = entries.min(0), entries.max(0) - entries.min(0)
        shift = np.maximum(np.array([int(r).bit_length() for r in reach]) - bits, 0)
        self.cell = (entries - low) >> shift
        grid = np.arange(1 << bits)[:, None]
        self.left = low + (grid << shift)  # (cells, width)
        self.right = self.left + (np.int64(1) << shift) - 1

    def bounds(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of parts (n, width) to the entries."""
        low, up = (np.zeros((len(asked), len(self.entries)), np.int64) for _ in range(2))
        for j in range(asked.shape[1]):
            under, over = self.left[:, j] - asked[:, j, None], asked[:, j, None] - self.right[:, j]
            gap = np.maximum(np.maximum(under, over), 0)
            far = np.maximum(-under, -over)
            low += np.take(gap * gap, self.cell[:, j], axis=1)
            up += np.take(far * far, self.cell[:, j], axis=1)
        return low, up

    def nearest(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part and its squared distance; ties go to the lower number."""
        best, error = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        for a in range(0, len(asked), AT_ONCE):
            part = asked[a : a + AT_ONCE]
            low, up = self.bounds(part)
            row, entry = np.nonzero(low <= up.min(1)[:, None])  # a row has one at least, in order of the entries
            apart = part[row] - self.entries[entry]
            distance = (apart * apart).sum(1)
            starts = np.searchsorted(row, np.arange(len(part)))
            least = np.minimum.reduceat(distance, starts)
            hit = np.flatnonzero(distance == least[row])
            first = hit[np.searchsorted(row[hit], np.arange(len(part)))]
            best[a : a + AT_ONCE], error[a : a + AT_ONCE] = entry[first], least
        return best, error


def scaled(vectors: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame, int]:
    """The kept table, its rows (vec_id, label, ints) that are cut alike, and the width of a part: see `compressed`."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    rows = vectors.select(whole_number(vectors, key).alias("vec_id"), F.col(label).alias("label"), x.alias("x"))
    rows = rows.where(F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    limit = float(MOST)
    ints = F.transform("x", lambda v: F.floor(F.greatest(F.least(v * float(SCALE), F.lit(limit)), F.lit(-limit))).cast("int"))
    rows = kept = keep(rows.select("vec_id", "label", ints.alias("ints")))
    top = rows.groupBy(F.size("ints").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if top is None:
        return kept, rows, 0
    width = -(-top["d"] // PARTS)
    rows = rows.where(F.size("ints") == top["d"])
    if width * PARTS > top["d"]:
        rows = rows.withColumn("ints", F.concat("ints", F.array_repeat(F.lit(0), width * PARTS - top["d"])))
    return kept, rows, width


def trained(rows: DataFrame, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (PARTS, entries, width) after the rounds. Only the first entries and sums by entry come to the driver."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(ENTRIES).select("ints").collect()
    books = np.array([r["ints"] for r in first], np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(books)  # PARTS * ENTRIES * width numbers

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cells = [Cells(b) for b in shared.value]
            sums, many = np.zeros(shared.value.shape, np.int64), np.zeros(shared.value.shape[:2], np.int64)
            for batch in batches:
                x = matrix(batch.column(0)).astype(np.int64).reshape(-1, PARTS, width)
                for p in range(PARTS):
                    at, _ = cells[p].nearest(x[:, p])
                    many[p] += np.bincount(at, minlength=many.shape[1])
                    np.add.at(sums[p], at, x[:, p])
            used = np.flatnonzero(many.ravel())
            if len(used):
                slot = (used[:, None] * width + np.arange(width)).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(sums.ravel()[slot]), pa.array(many.ravel()[slot // width])], names=["slot", "total", "many"])

        found = rows.select("ints").mapInArrow(run, "slot long, total long, many long").groupBy("slot").agg(F.sum("total").alias("total"), F.sum("many").alias("many"))
        flat = books.reshape(-1)
        for r in found.collect():  # at most a row for each number of the codebooks
            flat[r["slot"]] = r["total"] // r["many"]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(rows: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """(vec_id, label, code, error) of rows (vec_id, label, ints)."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in shared.value]
        for batch in batches:
            x = matrix(batch.column(2)).astype(np.int64).reshape(-1, PARTS, width)
            found = [cells[p].nearest(x[:, p]) for p in range(PARTS)]
            code = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(sum(f[1] for f in found))], names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of each row with a vector of finite numbers.

    Components become floor(256 * x); vectors are cut into 16 consecutive parts, each with a codebook of 64 entries, which
    starts as that part of the rows with the least vec_ids (null ids last; rows that share one go by their numbers) and is
    moved twice to the floored means of its parts; entries that nothing is nearest to stay. code has two hex digits a part,
    error is the sum of the parts' squared distances, label_error its sum over the rows of a label (null labels together).
    Rows may repeat; each counts. Rows whose vector is null, empty or holds null or non-finite components are dropped; so are
    vectors of another length than the most frequent one (the shorter of equals), since they cannot be cut alike. A length that
    16 does not divide is filled with zeros. Components beyond 2^17 count as 2^17. With fewer than 64 rows codebooks are as
    much smaller. No rows give no rows. Other columns play no part, whatever their names."""
    kept, rows, width = scaled(vectors, key, vector, label)
    if not width:
        return rows.selectExpr("vec_id", "label", "cast(null as string) code", "0L error", "0L label_error", "'' codebooks_sha256")
    books = trained(rows, width)
    found = keep(encoded(rows, books, width))
    forget(kept)
    totals = keep(found.groupBy(F.col("label").alias("its")).agg(F.sum("error").alias("label_error")))
    met = found.join(small(totals), F.col("label").eqNullSafe(F.col("its")))
    return met.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return compressed(table(spark, sf_dir, "embeddings")).drop("label")


def _round(name: str, before: str, books: str) -> str:
    """CTEs of one round: the nearest entry of every part among `books`, then the entries' floored means."""
    return f"""
{name}_near AS (
  SELECT x.r, x.part, min((list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + b.entry)) AS best
  FROM parts x JOIN {books} b USING (part) GROUP BY x.r, x.part),
{name}_means AS (
  SELECT part, entry, list(total ORDER BY pos) AS v FROM (
    SELECT n.part, n.best % 64 AS entry, pos, (sum(x.v[pos])::HUGEINT - ((sum(x.v[pos])::HUGEINT % count(*)) + count(*)) % count(*)) // count(*) AS total
    FROM {name}_near n JOIN parts x USING (r, part), (SELECT unnest(range(1, (SELECT max(len(v)) FROM parts) + 1)) AS pos) GROUP BY n.part, n.best % 64, pos)
  GROUP BY part, entry),
{name} AS (SELECT b.part, b.entry, coalesce(m.v::BIGINT[], b.v) AS v FROM {books} b LEFT JOIN {name}_means m USING (part, entry)),"""


#: DuckDB SQL for the query: every part against every entry.
SQL = f"""
WITH ok AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, p AS part, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS v FROM ok, (SELECT unnest(range(16)) AS p)),
zero AS (SELECT part, r - 1 AS entry, v FROM parts WHERE r <= 64),{_round("one", "parts", "zero")}{_round("two", "parts", "one")}
final AS (
  SELECT x.r, x.part, min((list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + b.entry)) AS best
  FROM parts x JOIN two b USING (part) GROUP BY x.r, x.part),
coded AS (
  SELECT r, string_agg(printf('%02x', (best % 64)::INTEGER), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM final GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM two)
SELECT ok.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM ok JOIN coded USING (r), books
"""
