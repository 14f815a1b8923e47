"""Nearest neighbours by additive quantisation.

A vector's direction is the sum of one word from each of several full-dimensional codebooks and of a rest. Codebooks start
as residual k-means and are refitted together by least squares; encoding is a beam search. An index row keeps the words'
numbers, the rest in steps of one byte a dimension, the vector's length and how far both codes may be from it (radii), and
not the vector. A query scores all index rows by lookup tables of its products with the words. By the radii
(Cauchy-Schwarz, with room for rounding) these scores have bounds that hold for any vectors; rows that may still be among
the nearest get the rest's part of the score, and those of them that still may are joined to their vectors and reranked
exactly. So nothing that is nearest is lost, whatever the rows are like; only the work depends on that."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, small, whole_number

BOOKS, WORDS, BEAM = 48, 32, 4
SAMPLE = 8192
QUERY_BLOCK, INDEX_BLOCK = 4096, 16384
EVERY, NEAREST = 20, 20


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        many = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], x[rng.choice(len(x), len(c))])
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The codes of each row and the sums that they stand for, by beam search over the books in their order."""
    n, (m, k, d) = len(x), books.shape
    rest = x[:, None, :].astype(np.float32)
    codes = np.zeros((n, 1, 0), np.uint8)
    for j in range(m):
        b = books[j]
        cost = (rest * rest).sum(2)[:, :, None] - 2 * rest @ b.T + (b * b).sum(1)
        flat = cost.reshape(n, -1)
        take = min(beam if j < m - 1 else 1, flat.shape[1])
        best = np.argpartition(flat, take - 1, axis=1)[:, :take]
        parent, word = best // k, best % k
        rows = np.arange(n)[:, None]
        codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
        rest = rest[rows, parent] - b[word]
    return codes[:, 0], x - rest[:, 0]


def refit(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The books that leave the least squares over, given the codes; a ridge keeps words that no row uses where they were."""
    m, k, d = books.shape
    left, right = np.zeros((m, k, m, k), np.float32), np.zeros((m * k, d), np.float32)
    codes = codes.astype(np.int64)
    for i in range(m):
        one = np.zeros((len(x), k), np.float32)
        one[np.arange(len(x)), codes[:, i]] = 1
        right[i * k : (i + 1) * k] = one.T @ x
        for j in range(i, m):
            left[i, :, j] = np.bincount(codes[:, i] * k + codes[:, j], minlength=k * k).reshape(k, k)
            left[j, :, i] = left[i, :, j].T
    flat = books.reshape(m * k, d)
    return np.linalg.solve(left.reshape(m * k, m * k) + 0.5 * np.eye(m * k, dtype=np.float32), right + 0.5 * flat).reshape(books.shape).astype(np.float32)


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, refits: int = 1, seed: int = 5) -> np.ndarray:
    """Codebooks (books, words, dimensions) of the sample x."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    words = max(1, min(words, len(x)))
    made, rest = [], x.copy()
    for _ in range(books):
        c = kmeans(rest, words, 5, rng)
        made.append(c)
        rest = rest - c[((c * c).sum(1) - 2 * rest @ c.T).argmin(1)]
    c = np.array(made, np.float32)
    for _ in range(refits):
        c = refit(x, encode(x, c)[0], c)
    return c


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vec): rows with a key and a vector of finite numbers, not all zero, of the most frequent length (the
    shorter one among equals); vectors of other lengths have no inner product with these and take no part. A key that comes
    repeatedly counts once, with its least vector. vec has the column's own type if that is of floats or doubles."""
    kind = vectors.schema[vector].dataType.elementType
    v = F.col(vector) if isinstance(kind, T.FloatType | T.DoubleType) else F.col(vector).cast("array<double>")
    fine = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(whole_number(vectors, key).alias("vec_id"), v.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(fine)
    rows = keep(rows)
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():  # vectors are only shuffled where keys repeat
        rows = keep(rows.groupBy("vec_id").agg(F.min("vec").alias("vec")))
    top = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vec") == (top["d"] if top else 0))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows at length 1, and their lengths, in double precision; squares neither overflow nor vanish on the way."""
    x = x.astype(float)
    most = np.abs(x).max(1, initial=0)
    most = np.where(most > 0, most, 1)
    x = x / most[:, None]
    length = np.sqrt((x * x).sum(1))
    length = np.where(length > 0, length, 1)
    return x / length[:, None], length * most


def coded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows of length 1: codes, rest in whole steps, the step, and two radii: how far the product with a query of length 1
    may be from its looked-up score, by the words alone (far) and with the rest (radius), rounding in floats included."""
    codes = encode(x.astype(np.float32), books)[0]
    m, _, d = books.shape
    rest, size = x.copy(), np.zeros(len(x))
    lengths = np.linalg.norm(books.astype(float), axis=2)
    for j in range(m):
        rest -= books[j][codes[:, j]]
        size += lengths[j][codes[:, j]]
    step = np.maximum(np.abs(rest).max(1, initial=0) / 127, 1e-30).astype(np.float32)
    fine = np.clip(np.rint(rest / step[:, None]), -127, 127).astype(np.int8)
    far, radius = (np.sqrt((r * r).sum(1)) for r in (rest, rest - fine * step[:, None].astype(float)))
    one = 1.2 * 2.0**-24  # a rounding in floats, with room
    slack = one * (d + m + 4) * size + 1e-9
    return codes, fine, step, far + slack, radius + slack + one * (d + 4) * (far + radius)


def indexed(rows: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """(vec_id, codes, fine, step, length, far, radius, same, equal) of every row of `usable`, kept; codebooks of about SAMPLE
    rows, chosen by hash; the number of rows. same and equal are two hashes that tell equal vectors."""
    n = rows.count()
    share = 1.0 if n <= SAMPLE else SAMPLE / n
    some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_000)) < max(1, int(1.2 * share * 1_000_000))).orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE).toPandas()
    some = some.sort_values("vec_id")
    if not len(some):
        some = rows.limit(SAMPLE).toPandas()
    schema = "vec_id long, codes binary, fine binary, step float, length double, far double, radius double, same long, equal long"
    if not len(some):
        return rows.sparkSession.createDataFrame([], schema), np.zeros((0, 0, 0), np.float32), 0
    books = train(unit(np.array(some["vec"].tolist(), float))[0])
    shared = rows.sparkSession.sparkContext.broadcast(books)  # BOOKS * WORDS vectors

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                x, length = unit(matrix(part.column(1)))
                codes, fine, *numbers = coded(x, shared.value)
                packed = [pa.array([c.tobytes() for c in cs], pa.binary()) for cs in (codes, fine)]
                step, far, radius = (pa.array(v) for v in numbers)
                yield pa.RecordBatch.from_arrays([part.column(0), *packed, step, pa.array(length), far, radius, part.column(2), part.column(3)], names=names)

    names = [c.split()[0] for c in schema.split(", ")]
    told = rows.select("vec_id", "vec", F.xxhash64("vec").alias("same"), F.xxhash64(F.lit(7), "vec").alias("equal"))
    return keep(told.mapInArrow(run, schema)), books, n


def first_copies(index: DataFrame, most: int) -> DataFrame:
    """The index without those rows that have `most` equal vectors of lesser vec_id before them."""
    often = index.groupBy("same", "equal").count().where(F.col("count") > most).drop("count")
    if often.isEmpty():
        return index
    often = small(keep(often))
    turn = F.row_number().over(Window.partitionBy("same", "equal").orderBy("vec_id"))
    few = index.join(often, ["same", "equal"], "left_semi").withColumn("turn", turn).where(F.col("turn") <= most).drop("turn")
    return index.join(often, ["same", "equal"], "left_anti").unionByName(few.select(*index.columns))


def block_search(ids, codes, fine, step, length, far, radius, query_ids, queries, books, nearest: int, metric: str, width: int = 64):
    """Of one block of the index and one of queries: (query id, vec id, least score, greatest score that it may have) of all
    rows that may be among the `nearest` of a query within the block. Scores are told up to what all rows of a query share:
    its length as a factor (ip) or its squared length (l2)."""
    m, k, d = books.shape
    order = np.argsort(ids, kind="stable")
    ids, codes, fine, step, length, far, radius = ids[order], np.ascontiguousarray(codes[order].T), fine[order], step[order], length[order], far[order], radius[order]
    words = books.reshape(m * k, d)
    n, room = len(ids), 0 if metric == "ip" else 1e-12
    queries, lengths = unit(queries)
    out: list[tuple] = []

    def bounds(score, rows, doubt):
        factor = length[rows, None] * (np.ones(score.shape[1]) if metric == "ip" else 2 * lengths[a : a + width])
        less = 0 if metric == "ip" else (length[rows] ** 2)[:, None]
        middle, by = factor * score - less, factor * doubt[rows, None] + room * less
        low, high = middle - by, middle + by
        low[own[rows]] = high[own[rows]] = -np.inf
        return low, high, np.partition(low, len(low) - nearest, axis=0)[len(low) - nearest] if n > nearest else np.full(low.shape[1], -np.inf)

    for a in range(0, len(queries), width):
        asked, names = queries[a : a + width].astype(np.float32), query_ids[a : a + width]
        tables = np.ascontiguousarray((words @ asked.T).reshape(m, k, len(asked)))
        score = np.zeros((n, len(asked)), np.float32)
        part = np.empty((1024, len(asked)), np.float32)
        for b in range(0, n, 1024):
            here = score[b : b + 1024]
            for j in range(m):
                here += np.take(tables[j], codes[j, b : b + 1024], axis=0, out=part[: len(here)], mode="clip")
        own = np.zeros(score.shape, bool)
        at = np.minimum(np.searchsorted(ids, names), n - 1)
        mine = np.flatnonzero(ids[at] == names)
        own[at[mine], mine] = True
        _, high, least = bounds(score, np.arange(n), far)
        rows = np.flatnonzero((high >= least).any(1))
        score = score[rows]
        for b in range(0, len(rows), 1024):
            r = rows[b : b + 1024]
            score[b : b + 1024] += (fine[r] * step[r, None]) @ asked.T
        low, high, least = bounds(score, rows, radius)
        r, c = np.nonzero((high >= least) & ~own[rows])
        out.append((names[c], ids[rows[r]], low[r, c], high[r, c]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def exact(left: Column, right: Column, metric: str) -> Column:
    """The inner product, or for l2 the negative squared distance, in double precision."""
    each = lambda a, b: a.cast("double") * b.cast("double") if metric == "ip" else -((a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.aggregate(F.zip_with(left, right, each), F.lit(0.0), lambda s, x: s + x)


def search(index: DataFrame, books: np.ndarray, n: int, vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, metric: str = "ip") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of the index to each query (vec_id, vec), its own key left out.

    Index and queries are dealt to blocks by hash, and each pair of blocks is one group; a group holds about QUERY_BLOCK
    by INDEX_BLOCK rows whatever the sizes, and of the index it gets codes alone. Of equal vectors only the nearest + 1 of
    least vec_id can be in a result; the others stay in the index but are not dealt. The rows that may be among a query's
    nearest over all blocks are joined to their vectors (vec_id, vec); how many they are follows from the radii, without a
    cap, and all that are nearest are among them. score is exact, in double precision, on the vectors given: the inner product, or for metric l2 the negative
    squared distance. Ties go to the smaller vec_id. No rows or no queries give no rows."""
    many = queries.count()
    if not n or not many:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    qb, ib = -(-many // QUERY_BLOCK), -(-n // INDEX_BLOCK)
    shared = index.sparkSession.sparkContext.broadcast(books)
    deal = lambda seed, blocks: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = first_copies(index, nearest + 1).drop("same", "equal").withColumn("ib", deal(1, ib)).withColumn("qb", every(qb))
    right = queries.select(F.col("vec_id").alias("query_id"), "vec", deal(2, qb).alias("qb")).withColumn("ib", every(ib))

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        q, v, low, most = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        if rows.num_rows and asked.num_rows:
            rows, asked = rows.combine_chunks(), asked.combine_chunks()
            one = lambda t, c: t.column(c).combine_chunks() if not isinstance(t.column(c), pa.Array) else t.column(c)
            number = lambda t, c: one(t, c).to_numpy(zero_copy_only=False)
            codes, fine = (np.frombuffer(b"".join(one(rows, c).to_pylist()), kind).reshape(rows.num_rows, -1) for c, kind in (("codes", np.uint8), ("fine", np.int8)))
            numbers = (number(rows, c) for c in ("step", "length", "far", "radius"))
            q, v, low, most = block_search(number(rows, "vec_id"), codes, fine, *numbers, number(asked, "query_id"), matrix(one(asked, "vec")), shared.value, nearest, metric)
        return pa.table({"query_id": q, "vec_id": v, "low": low, "most": most})

    found = keep(left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInArrow(run, "query_id long, vec_id long, low double, most double"))
    # a query's `nearest`-th best least score over all blocks; with fewer rows, all may be among its nearest
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))
    least = found.withColumn("place", place).where(F.col("place") <= nearest).groupBy("query_id").agg(F.when(F.count("*") == nearest, F.min("low")).alias("least"))
    maybe = found.join(least, "query_id").where(F.col("least").isNull() | (F.col("most") >= F.col("least"))).select("query_id", "vec_id")
    met = maybe.join(vectors.select("vec_id", "vec"), "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("asked")), "query_id")
    scored = met.select("query_id", "vec_id", exact(F.col("vec"), F.col("asked"), metric).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    index, books, n = indexed(rows)
    return search(index, books, n, rows, rows.where(F.col("vec_id") % EVERY == 0))
