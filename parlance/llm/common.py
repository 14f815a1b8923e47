"""What the corpus operators share: Arrow passes over a table, tables kept between jobs, and folds."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one is made and set, but
    only if driver and executors are one process (tests); on a cluster the setting is asked for."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="parlance-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


_kept: dict[str, SparkSession] = {}


def _delete(path: str, spark: SparkSession) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _drop_kept() -> None:
    for path, spark in _kept.items():
        try:
            _delete(path, spark)
        except Exception:  # the session has ended already
            return


def keep(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: the plan that made it ends here, and a lost executor costs
    no more than a read. The files go with `forget`, or when the driver ends."""
    spark = df.sparkSession
    if not _kept:
        atexit.register(_drop_kept)
    path = f"{shared_folder(spark)}/parlance/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _kept[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def forget(*kept: DataFrame) -> None:
    """Delete the files of tables that `keep` gave and that nothing reads any more."""
    for df in kept:
        path = df.kept_at
        _delete(path, _kept.pop(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, in any case of letters."""
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone))


def fresh(df: DataFrame, *names: str) -> SimpleNamespace:
    """For each name a column name like it that df does not have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, SimpleNamespace()
    for name in names:
        own = f"__{name}"
        while own in taken:
            own += "_"
        setattr(out, name, own)
    return out


def whole_number(df: DataFrame, key: str) -> Column:
    """A key as a long. Keys that are not whole numbers are told by a 64-bit hash of their text; null stays null."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.LongType | T.IntegerType | T.ShortType | T.ByteType):
        return F.col(f"`{key}`").cast("long")
    return F.when(F.col(f"`{key}`").isNotNull(), F.xxhash64(F.col(f"`{key}`").cast("string")))


def remainder(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo `of`; null keys count as -1, which belongs to no fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % of, F.lit(-1))


def cuts(columns: list[pa.Array], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose strings in these columns take about `limit` bytes, and at most 4000 rows, together; one row at
    least."""
    sizes = [np.diff(strings(c)[1]) for c in columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
    n = len(columns[0]) if columns else 0
    upto = np.concatenate([[0], np.cumsum(sum(sizes) if sizes else np.zeros(n, np.int64))])
    i = 0
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(upto, upto[i] + limit, side="right")) - 1), i + 4000)
        yield i, j
        i = j


def append(df: DataFrame, inputs: list[str], fields: list[T.StructField], make: Callable[..., list[pa.Array]], limit: int = 4 << 20) -> DataFrame:
    """df with the fields that make(*input arrays) gives for each Arrow batch; columns of the same names are replaced.
    make gets and returns Arrow arrays of equal length. Batches are cut by rows and by `limit` bytes of the input strings,
    and each cut is given on before the next is made, so memory follows the longest text, not the batch."""
    names = [f.name for f in fields]
    base = without(df, *names)
    at = [base.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in cuts([batch.column(k) for k in at], limit):
                part = batch.slice(i, j - i)
                cols = [part.column(k) for k in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(cols + make(*(cols[k] for k in at)), names=[*part.schema.names, *names])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *fields]))


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, marked for broadcast if it has `most` rows or fewer by count; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def before(df: DataFrame, order: list[Column], sums: dict[str, Column], most: int = 100_000) -> DataFrame:
    """df with the sums (of longs) over all rows that come before a row in the order, for tables of any size: rows are dealt
    to ranges of about `most` rows, and a range begins with the sums of the ranges before it. The order must be total."""
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda k, w: F.coalesce(F.sum(k).over(earlier(w)), F.lit(0).cast("long"))
    n = -(-df.count() // most)
    if n <= 1:
        return df.select("*", *(upto(c.cast("long"), Window.orderBy(*order)).alias(k) for k, c in sums.items()))
    ranged = keep(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()).select("*", *(c.cast("long").alias(f"__{k}") for k, c in sums.items())))
    totals = ranged.groupBy("__range").agg(*(F.sum(f"__{k}").alias(f"__all_{k}") for k in sums))
    ranges = Window.orderBy("__range")  # a row a range
    starts = totals.select("__range", *(upto(f"__all_{k}", ranges).alias(f"__start_{k}") for k in sums))
    own = Window.partitionBy("__range").orderBy(*order)
    met = ranged.join(small(keep(starts)), "__range")
    return met.select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(f"__start_{k}") + upto(f"__{k}", own)).alias(k) for k in sums))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df, kept, with `name`: the numbers from 1 of the rows that share a key, for keys of any number of rows: rows are
    numbered within their partitions, after the key's rows in the partitions before."""
    x = fresh(df, "part", "n", "its", "where", "start", "turn")
    parted = keep(df.withColumn(x.part, F.spark_partition_id()))
    counted = parted.groupBy(key, x.part).agg(F.count("*").alias(x.n))
    earlier = Window.partitionBy(key).orderBy(x.part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(F.col(key).alias(x.its), F.col(x.part).alias(x.where), F.coalesce(F.sum(x.n).over(earlier), F.lit(0).cast("long")).alias(x.start))
    turn = F.row_number().over(Window.partitionBy(key, x.part).orderBy(key))
    met = parted.withColumn(x.turn, turn).join(starts, (F.col(key) == F.col(x.its)) & (F.col(x.part) == F.col(x.where)))
    return keep(met.select(*(F.col(f"`{c}`") for c in df.columns), (F.col(x.start) + F.col(x.turn)).cast("long").alias(name)))


def sampled_labels(labels: DataFrame, label: str, fold: int, held: int, bound: int) -> DataFrame:
    """At most about `bound` labelled rows (doc_id, y) outside the held-out remainder, chosen by a hash of doc_id, so that
    reruns agree. A doc_id with several labels counts by their mean; null ids or labels take no part."""
    rows = labels.select("doc_id", F.col(label).cast("double").alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (remainder(F.col("doc_id"), fold) != held)
    )
    n = rows.select(F.count("*")).first()[0]
    share = 1.0 if n <= bound else 0.97 * bound / n
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(1_000_000)) < int(share * 1_000_000))
    return chosen.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(77)), "doc_id").limit(bound)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, fold: int, held: int, bound: int) -> DataFrame:
    """(doc_id, text, y) of the sampled labels, one row a doc_id: of texts that share one the least counts, so the sample
    stays within its bound. It is at most `bound` rows of two numbers, so it is broadcast."""
    chosen = sampled_labels(labels, label, fold, held, bound)
    met = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def strings(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array as one array, and the n+1 offsets into it; null counts as empty."""
    if values.null_count:
        values = values.fill_null("")
    kind = np.int64 if pa.types.is_large_string(values.type) else np.int32
    _, offsets, data = values.buffers()
    off = np.frombuffer(offsets, kind)[values.offset : values.offset + len(values) + 1].astype(np.int64) if len(values) else np.zeros(1, np.int64)
    if data is None or not len(values):
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights of a small dense logistic regression by Newton's method; the last one is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + l2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        move = np.linalg.solve(h, g)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w
