"""Near duplicates: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

Steps: a sketch of each text; texts of the same shingle set form a class, of which one member goes on; classes meet in
buckets by bands of their sketches; a bucket gives edges from one centre to its other members; edges are confirmed on
full shingle sets; components follow. A star leaves pairs of its members untested. Where a bucket holds several components
afterwards, its members outside the most frequent one are compared with all, block by block inside tasks that give only
what passes. So every pair of one bucket is either in one component or compared, with no cap, while rows between stages
grow with the members of buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, fresh, keep, small, whole_number
from .components import components
from .words import U, mix, scan, shingles, slices

#: Bands and rows a band. At a likeness of 0.8 a pair misses every bucket with a chance of 5e-8.
BANDS, ROWS = 32, 4
#: Nodes a side that one task compares at once, and shingles (of 4 bytes) that these have together; a greater set is alone.
BLOCK, BLOCK_SHINGLES = 1000, 2_000_000
#: Up to so many places of wanted texts (24 bytes each) go to all tasks that read the texts; beyond, texts are shuffled.
MOST_BROADCAST = 1_000_000


def sets(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, sorted, one after the other, and their n+1 offsets."""
    each = [np.unique(hashes[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    return (np.concatenate(each) if each else np.zeros(0, U)), np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)


def names(values: np.ndarray, off: np.ndarray) -> list[bytes]:
    """16 bytes that stand for a whole set: two sums of mixed hashes."""
    one, two = np.zeros(len(values) + 1, U), np.zeros(len(values) + 1, U)
    np.cumsum(mix(values), out=one[1:])
    np.cumsum(mix(values ^ U(0x5851F42D4C957F2D)), out=two[1:])
    both = np.column_stack([mix(one[off[1:]] - one[off[:-1]]), two[off[1:]] - two[off[:-1]]]).astype(">u8")
    return [r.tobytes() for r in both]


def sketch(values: np.ndarray, off: np.ndarray, bins: int) -> np.ndarray:
    """One hash function deals a set's hashes to bins by their value; a bin keeps its least. An empty bin takes the value
    of the first full one among bins drawn by a hash of (bin, attempt): the same draws for every set. Sets are not empty."""
    n = len(off) - 1
    out = np.zeros((n, bins), U)
    full = np.zeros((n, bins), bool)
    row = np.repeat(np.arange(n), np.diff(off))
    at = (((values >> U(32)) * U(bins)) >> U(32)).astype(np.int64)
    lead = np.ones(len(values), bool)
    lead[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    out[row[lead], at[lead]] = values[lead]
    full[row[lead], at[lead]] = True
    r, b = np.nonzero(~full & full.any(1)[:, None])
    attempt = 0
    while len(r):
        attempt += 1
        draw = ((mix(b.astype(U) * U(0x9E3779B97F4A7C15) + U(attempt)) >> U(32)) * U(bins) >> U(32)).astype(np.int64)
        if attempt > 40 * bins:  # not reached but for very few full bins: the next full one
            draw = (b + attempt) % bins
        hit = full[r, draw]
        out[r[hit], b[hit]] = out[r[hit], draw[hit]]
        r, b = r[~hit], b[~hit]
    return out


def bands(sketches: np.ndarray, many: int, rows: int) -> np.ndarray:
    """A bucket number for each band of each sketch."""
    salt = mix(np.arange(1, rows + 1, dtype=U))
    parts = sketches[:, : many * rows].reshape(len(sketches), many, rows)
    return mix((mix(parts) * salt).sum(2, dtype=U) + mix(np.arange(1, many + 1, dtype=U) << U(20))).astype(np.int64)


def place(docs: DataFrame, key: str, text: str) -> Column:
    """What tells a row: its key, or a hash of its text where the key is null."""
    return F.coalesce(whole_number(docs, key), F.xxhash64(F.col(f"`{text}`")))


def sketched(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(doc_id, place, hash, n_shingles, node, buckets) a row; place and hash of the text tell it, and node names the
    shingle set. Without words node and buckets are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, off in slices(batch.column(3)):
                values, of = sets(*shingles(scan(data, off), k))
                n = np.diff(of)
                some = n > 0
                ends = np.concatenate([[0], np.cumsum(n[some])])
                node = np.full(len(n), None, object)
                node[some] = names(values, ends)
                numbers = bands(sketch(values, ends, BANDS * ROWS), BANDS, ROWS)
                width = np.where(some, BANDS, 0)
                offsets = pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32))
                here = batch.slice(first, len(n))
                yield pa.RecordBatch.from_arrays([here.column(0), here.column(1), here.column(2), pa.array(n.astype(np.int64)), pa.array(node, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(numbers.ravel()))], names=schema.names)

    schema = T.StructType.fromDDL("doc_id long, place long, hash long, n_shingles long, node binary, buckets array<long>")
    return docs.select(whole_number(docs, key).alias("doc_id"), place(docs, key, text).alias("place"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text")).mapInArrow(run, schema)


def full_sets(docs: DataFrame, wanted: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(node, set) of the wanted classes (node, place): shingle sets made again from the text of one member each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, off in slices(batch.column(1)):
                values, of = sets(*shingles(scan(data, off), k))
                lists = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(values.astype(np.int64)))
                nodes = pa.array([n if b > a else None for n, a, b in zip(names(values, of), of[:-1], of[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([nodes, lists, batch.column(0).slice(first, len(nodes))], names=["node", "set", "wanted"])

    texts = docs.select(place(docs, key, text).alias("place"), F.col(text).alias("text"))
    made = texts.join(wanted, "place").select("node", "text").mapInArrow(run, "node binary, set array<long>, wanted binary")
    return made.where("node = wanted").select("node", "set").dropDuplicates(["node"])


def confirmed(edges: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose sets have 100 * intersection >= percent * union."""
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = pairs.join(full.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(full.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    met = met.where(F.least(F.size("x"), F.size("y")) * 100 >= F.greatest(F.size("x"), F.size("y")) * percent)
    return met.where(shared * 100 >= (F.size("x") + F.size("y") - shared) * percent).select("a", "b")


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def untested(left: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes with different labels in one bucket of left (bucket, node, label, n the set's size) whose sets
    are likely to be alike enough; of a node and a label one pair is enough. Buckets of one label give none.

    Nodes outside a bucket's most frequent label meet all its nodes. A bucket is dealt to groups of about BLOCK such nodes by
    BLOCK of all, or fewer where their sets are large (BLOCK_SHINGLES a side), so that no group outgrows a task; a group
    compares its sets, cut to 32 bits a shingle, at once and gives only what passes, so rows grow with the members of
    buckets, not with their pairs."""
    sizes = left.groupBy("bucket", "label").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    # kept before the join, so that Spark may split the join's partition of a large bucket
    counted = keep(sizes.groupBy("bucket").agg(F.count("*").alias("labels"), F.max(F.struct("size", "label", "n")).alias("most"), F.sum("size").alias("many"), F.sum("n").alias("all")).where("labels > 1").drop("labels"))
    marked = left.drop("n").join(counted, "bucket").withColumn("minor", F.col("label") != F.col("most.label"))
    part = lambda size, n: F.greatest(F.ceil(size / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    minors = part(F.col("many") - F.col("most.size"), F.col("all") - F.col("most.n"))
    blocks = part(F.col("many"), F.col("all"))
    at = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    right = F.transform(upto(minors), lambda i: F.struct(i.alias("i"), at(blocks, 1).alias("j"), F.lit(False).alias("left")))
    lefts = F.transform(upto(blocks), lambda j: F.struct(at(minors, 2).alias("i"), j.alias("j"), F.lit(True).alias("left")))
    short = F.transform("set", lambda v: v.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    sized = marked.join(full.select("node", short.alias("set")), "node")
    every = F.when(F.col("minor"), F.concat(lefts, right)).otherwise(right)
    dealt = sized.select("bucket", "node", "label", "set", F.explode(every).alias("at")).select("bucket", F.col("at.i").alias("i"), F.col("at.j").alias("j"), F.col("at.left").alias("left"), "node", "label", "set")

    def run(group: pa.Table) -> pa.Table:
        left = group.column("left").to_numpy()
        nodes, marks = group.column("node").to_pylist(), group.column("label").to_pylist()
        lists = group.column("set").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        _, word, many = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = many[word] > 1
        row, word = row[shared], np.unique(word[shared], return_inverse=True)[1]
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        place = np.zeros(len(size), np.int64)
        place[a], place[b] = np.arange(len(a)), np.arange(len(b))
        both = np.zeros((len(a), len(b)), np.float32)
        for k in range(0, int(word.max(initial=-1)) + 1, 2048):  # columns of the two incidence matrices, some at a time
            here = (word >= k) & (word < k + 2048)
            r, w = row[here], word[here] - k
            x, y = np.zeros((len(a), 2048), np.float32), np.zeros((len(b), 2048), np.float32)
            x[place[r[left[r]]], w[left[r]]] = 1
            y[place[r[~left[r]]], w[~left[r]]] = 1
            both += x @ y.T
        union = size[a][:, None] + size[b][None, :] - both
        i, j = np.nonzero(both * 100 >= (percent - 0.05) * union)
        best = np.argsort(-(both[i, j] / union[i, j]), kind="stable")  # so that the pair kept of a node and a label is their likest
        i, j = i[best], j[best]
        found: dict[tuple, tuple] = {}
        for p, q in zip(a[i].tolist(), b[j].tolist(), strict=True):
            if marks[p] != marks[q]:
                found.setdefault((p, marks[q]), (nodes[p], nodes[q]))
        return pa.table({"a": pa.array([f[0] for f in found.values()], pa.binary()), "b": pa.array([f[1] for f in found.values()], pa.binary())})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(run, "a binary, b binary")


def grouped(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, place, hash, n_shingles, component_id, keeper) for each row of docs.

    Two texts are linked if their sets of k-word shingles have a likeness of `percent` per cent or more; component_id is
    the least doc_id that links lead to. Texts without words (null, empty, blank) are linked with nothing. Null doc_ids
    take part in links, but name no component while another row does. A key may repeat with other texts: place and the hash
    of its text tell a row, and keeper (place, hash) is the one to keep; of rows equal in both it means any. Texts of any
    length count with all their shingles; what a task holds grows with the longest one. No rows give no rows."""
    rows = keep(sketched(docs, k, key, text))
    ids = F.min("doc_id").alias("least_id"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "place", "hash")).alias("first")
    classes = keep(rows.where("node is not null").groupBy("node").agg(F.min("place").alias("place"), F.max("n_shingles").alias("n"), *ids))
    heads = rows.where("node is not null").join(classes.select("node", "place"), ["node", "place"]).dropDuplicates(["node", "place"])
    heads = heads.select("node", F.explode("buckets").alias("bucket")).withColumn("draw", F.xxhash64("node", "bucket"))
    several = heads.groupBy("bucket").agg(F.count("*").alias("many"), F.min("draw").alias("least")).where("many > 1")
    members = keep(heads.join(several, "bucket").select("bucket", "node", (F.col("draw") == F.col("least")).alias("central")))
    nodes = keep(members.select("node").distinct().join(classes.select("node", "place"), "node"))
    wanted = F.broadcast(nodes) if nodes.count() <= MOST_BROADCAST else nodes
    full = keep(full_sets(docs, wanted, k, key, text))
    centres = members.where("central").select("bucket", F.col("node").alias("centre"))
    star = members.join(centres, "bucket").where("node <> centre")
    labels = components(confirmed(star.select(F.col("node").alias("a"), F.col("centre").alias("b")), full, percent))
    left = keep(labelled(members.select("bucket", "node"), labels).join(full.select("node", F.size("set").cast("long").alias("n")), "node"))
    more = confirmed(untested(left, full, percent), full, percent)
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    met = more.join(of("a"), "a", "left").join(of("b"), "b", "left")
    # labels are the least nodes of their components, so components of labels give the least nodes of the whole
    united = components(met.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    forget(nodes, full, members, left)
    whole = labelled(classes, labels).join(small(united.select(F.col("node").alias("label"), F.col("label").alias("least"))), "label", "left")
    whole = whole.withColumn("label", F.coalesce("least", "label")).drop("least")
    ends = whole.groupBy("label").agg(F.min("least_id").alias("component_id"), F.min("first").alias("first"))
    ends = ends.select("label", "component_id", F.struct("first.place", "first.hash").alias("keeper"))
    found = keep(whole.select("node", "label").join(ends, "label").select("node", "component_id", "keeper"))
    forget(labels, united, classes)
    joined = rows.select("doc_id", "place", "hash", "n_shingles", "node").join(found, "node", "left")
    alone = F.col("node").isNull()
    component, keeper = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")), F.when(alone, F.struct("place", "hash")).otherwise(F.col("keeper"))
    return joined.select("doc_id", "place", "hash", "n_shingles", component.alias("component_id"), keeper.alias("keeper"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near duplicates: of each component the row with the least key (then the least hash of its text) stays,
    with all its columns. Rows that repeat a key with the same text count once, those that repeat it with another text
    are rows of their own; texts without words all stay."""
    found = grouped(docs, k, percent, key, text).where((F.col("place") == F.col("keeper.place")) & (F.col("hash") == F.col("keeper.hash")))
    x = fresh(docs, "place", "hash")
    told = [x.place, x.hash]
    kept = keep(found.groupBy(F.col("place").alias(x.place), F.col("hash").alias(x.hash)).agg(F.count("*").alias("n"), F.max("n_shingles").alias("words")))
    marked = docs.withColumn(x.place, place(docs, key, text)).withColumn(x.hash, F.xxhash64(F.col(f"`{text}`"))).join(kept.select(*told), told, "left_semi")
    twice = keep(kept.where("n > 1 and words > 0").select(*told))
    if not twice.isEmpty():  # rows that repeat key and text: the first that partial aggregation meets
        marked = marked.join(twice, told, "left_anti").unionByName(marked.join(twice, told, "left_semi").dropDuplicates(told))
    return marked.drop(*told)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = grouped(table(spark, sf_dir, "documents"), k=2)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
