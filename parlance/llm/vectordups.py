"""Near duplicates among vectors: small-world graphs per shard, searched by all vectors of their label.

Equal vectors form a class, of which one goes on. Classes of one label are dealt to shards of bounded size; each shard's graph
is built once and kept. Every class searches its own shard and those with higher numbers (the others search it), with beams that
widen until an audit against brute force passes; a beam that is full of links widens on, at last to the whole shard. Found
pairs are verified in double precision inside the task, which gives each class the number of its links and the root of the
component that they make within the task. So rows between stages grow with vectors, not with links; these components are then
united over all tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import smallworld
from .common import forget, keep, small, whole_number
from .components import components
from .neighbours import matrix
from .words import U, mix

LEAST = 0.93
#: Rows of a shard at most, and bytes of its vectors in double precision.
SHARD_ROWS, SHARD_BYTES = 8192, 16 << 20
#: The first beam's width, and the widest before the whole shard is compared.
FIRST, WIDEST = 32, 256
#: Share of the audit's links that must be found; vectors that an audit asks for.
RECALL, AUDIT = 0.995, 256
#: Vectors that are compared with a whole shard at once.
ROWS = 256


def audit(graph: smallworld.Graph, u: np.ndarray, asked: np.ndarray, ids: np.ndarray, full: np.ndarray, least: float, width: int) -> bool:
    """Whether beams of this width find the links of some of the asked vectors, by comparison with all of the shard, and
    whether they find nodes of the graph from points that are just as far from them as a link may be."""
    n, d = u.shape
    some = np.flatnonzero(~full)
    some = some[np.argsort(mix(some.astype(U)))[:AUDIT]]
    true = found = 0
    for a in range(0, len(some), ROWS):
        link = asked[some[a : a + ROWS]] @ u.T >= least
        got = np.zeros((len(link), n + 1), bool)
        got[np.arange(len(link))[:, None], ids[some[a : a + ROWS]]] = True  # -1 is the last column
        true, found = true + int(link.sum()), found + int((link & got[:, :n]).sum())
    if found < RECALL * true:
        return False
    if d < 2:
        return True
    nodes = np.argsort(mix(np.arange(n, dtype=U) + U(n)))[:AUDIT]
    side = np.random.default_rng(n).normal(size=(len(nodes), d))
    side -= (side * u[nodes]).sum(1, keepdims=True) * u[nodes]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    probes, _ = smallworld.search(graph, least * u[nodes] + math.sqrt(1 - least * least) * side, width)
    value = np.einsum("pd,pkd->pk", side, u[np.maximum(probes, 0)]) * math.sqrt(1 - least * least) + least * np.einsum("pd,pkd->pk", u[nodes], u[np.maximum(probes, 0)])
    crowded = (value >= least - 1e-9).all(1)  # in a dense place the beam is full of links, and would widen
    return bool(((probes == nodes[:, None]).any(1) | crowded).mean() >= RECALL)


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of a and b, pair by pair; root names each node's least one so far."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root[:] = up


def linked(graph: smallworld.Graph, u: np.ndarray, weight: np.ndarray, asked: np.ndarray, asked_weight: np.ndarray, own: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of the asked, links of the nodes, root of each) between asked unit vectors (double) and the graph's nodes, whose
    unit vectors are u. With `own` the asked are the nodes, in the same order. A root is a number of an asked vector, or of a
    node counted on from these."""
    n, q = len(u), len(asked)
    shift = 0 if own else q
    root = np.arange(n + shift)
    mine, theirs = np.zeros(q), np.zeros(n)
    width, wide = FIRST, np.ones(q, bool)
    ids = np.zeros((q, 0), np.int64)
    while width * 4 <= n and width <= WIDEST:
        ids, near = smallworld.search(graph, asked, width)
        wide = near[:, -1] >= least - 1e-3
        if audit(graph, u, asked, ids, wide, least, width):
            break
        width, ids, wide = width * 2, np.zeros((q, 0), np.int64), np.ones(q, bool)
    a, c = np.nonzero(np.where(wide[:, None], -1, ids) >= 0)
    b = ids[a, c]
    more = np.flatnonzero(wide)
    while len(more) and ids.shape[1] and width * 8 <= n and width * 2 <= WIDEST:  # beams that are full of links
        width *= 2
        wider, near = smallworld.search(graph, asked[more], width)
        ends = near[:, -1] < least - 1e-3
        r, c = np.nonzero(np.where(ends[:, None], wider, -1) >= 0)
        a, b = np.concatenate([a, more[r]]), np.concatenate([b, wider[r, c]])
        more = more[~ends]
    whole = np.zeros(q, bool)
    whole[more] = True
    if own:
        fine = (a != b) & ~whole[b]
        key = np.unique(np.minimum(a[fine], b[fine]) * n + np.maximum(a[fine], b[fine]))
        a, b = key // n, key % n
    for i in range(0, len(a), 1 << 16):
        x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
        link = np.einsum("pd,pd->p", asked[x], u[y]) >= least
        x, y = x[link], y[link]
        mine += np.bincount(x, weight[y], q)
        theirs += np.bincount(y, asked_weight[x], n)
        unite(root, x, y + shift)
    for i in range(0, len(more), ROWS):  # the widest beam: all of the shard
        x = more[i : i + ROWS]
        link = asked[x] @ u.T >= least
        if own:
            link[np.arange(len(x)), x] = False
        mine[x] += link @ weight
        back = asked_weight[x] @ link
        theirs += np.where(whole, 0, back) if own else back
        r, c = np.nonzero(link)
        unite(root, x[r], c + shift)
    return mine, theirs, root


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, vec, one, two): one and two are hashes that tell a vector, null where it takes no part."""
    kind = vectors.schema[vector].dataType.elementType
    v = F.col(vector) if isinstance(kind, T.FloatType | T.DoubleType) else F.col(vector).cast("array<double>")
    rows = vectors.select(whole_number(vectors, key).alias("vec_id"), F.col(label).alias("label"), v.alias("vec"))
    fine = F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.select("vec_id", "label", "vec", F.when(fine, F.xxhash64("vec")).alias("one"), F.when(fine, F.xxhash64(F.lit(29), "vec")).alias("two"))


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(float)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def graphs(dealt: DataFrame) -> DataFrame:
    """(label, d, shard, shards, node, weight, vecs, links): a row a shard with its graph, of dealt classes."""
    kind = dealt.schema["label"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        node, weight = (group.column(c).to_numpy() for c in ("node", "weight"))
        at, sizes = smallworld.order(node)
        x = unit(matrix(group.column("vec").combine_chunks()))[at]
        graph = smallworld.build(x, sizes)
        one = lambda c: group.column(c).slice(0, 1)
        links = [x.astype(np.int32).tobytes() for x in graph.layers]
        return pa.table({"label": one("label"), "d": one("d"), "shard": one("shard"), "shards": one("shards"), "node": pa.array([node[at]], pa.list_(pa.int64())), "weight": pa.array([weight[at]], pa.list_(pa.int64())), "vecs": pa.array([x.tobytes()], pa.binary()), "links": pa.array([links], pa.list_(pa.binary()))})

    return dealt.groupBy("label", "d", "shard").applyInArrow(run, f"label {kind}, d int, shard int, shards int, node array<long>, weight array<long>, vecs binary, links array<binary>")


def searched(built: DataFrame, dealt: DataFrame, least: float) -> DataFrame:
    """(node, links, root): of each shard and each block of asked classes, those that have links, how many, and the root of
    their component there."""
    upto = lambda a, b: F.explode(F.sequence(a, b))
    left = built.withColumn("block", upto(F.lit(0), F.col("shard")))
    right = dealt.select("label", "d", F.col("shard").alias("block"), "node", "weight", "vec", upto(F.col("shard"), F.col("shards") - 1).alias("shard"))

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        if not shard.num_rows or not block.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        get = lambda c: shard.column(c)[0]
        node, weight = get("node").values.to_numpy(), get("weight").values.to_numpy().astype(float)
        d, n = get("d").as_py(), len(node)
        u = np.frombuffer(get("vecs").as_py(), float).reshape(n, d)
        layers = [np.frombuffer(b, np.int32).astype(np.int64).reshape(-1, smallworld.LINKS * (2 if k == 0 else 1)) for k, b in enumerate(get("links").as_py())]
        graph = smallworld.Graph(np.concatenate([u.astype(np.float32), np.zeros((1, d), np.float32)]), layers)
        own = block.column("block")[0].as_py() == block.column("shard")[0].as_py()
        if own:
            asked, names, many = u, node, weight
        else:
            names = block.column("node").to_numpy()
            at = np.argsort(names, kind="stable")
            names, many = names[at], block.column("weight").to_numpy().astype(float)[at]
            asked = unit(matrix(block.column("vec").combine_chunks()))[at]
        mine, theirs, root = linked(graph, u, weight, asked, many, own, least)
        every = node if own else np.concatenate([names, node])
        links = (mine + theirs if own else np.concatenate([mine, theirs])).astype(np.int64)
        has = np.flatnonzero(links > 0)
        return pa.table({"node": every[has], "links": links[has], "root": every[root[has]]})

    keys = "label", "d", "shard", "block"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "node long, links long, root long")


def grouped(vectors: DataFrame, least: float = LEAST, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Rows with equal labels and vectors of equal length are linked if their cosine is `least` or more, in double precision.
    Null labels and vectors that are null, empty, zero or hold null or non-finite components are linked with nothing. Equal
    vectors of a label are linked with each other, also where rows repeat a vec_id; each row counts. component_id is the least
    vec_id that links lead to; null ids take part in links, but name no component while another row does. A label of any size
    is searched in shards, equal vectors once. Other columns play no part, whatever their names. No rows give no rows."""
    rows = usable(vectors, key, vector, label)
    told = ["label", "one", "two"]
    classes = rows.where("one is not null").groupBy(*told).agg(F.first("vec").alias("vec"), F.count("*").alias("weight"), F.min("vec_id").alias("least_id"))
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("d", F.size("vec")))
    per = F.greatest(F.least(F.lit(SHARD_ROWS), F.floor(F.lit(SHARD_BYTES) / (F.col("d") * 8))), F.lit(1))
    shards = keep(classes.groupBy("label", "d").agg(F.count("*").alias("n")).select("label", "d", F.ceil(F.col("n") / per).cast("int").alias("shards")))
    dealt = classes.join(small(shards), ["label", "d"])
    dealt = dealt.select("label", "d", "shards", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int").alias("shard"), "node", "weight", "vec")
    built = keep(graphs(dealt))
    found = keep(searched(built, dealt, least))
    forget(built)
    labels = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = classes.drop("vec").join(links, "node", "left").join(labels.withColumnRenamed("label", "its"), "node", "left").withColumn("its", F.coalesce("its", "node"))
    ends = keep(whole.groupBy("its").agg(F.min("least_id").alias("component_id")))
    named = keep(whole.join(ends, "its").select(*told, (F.col("weight") - 1 + F.coalesce("links", F.lit(0).cast("long"))).alias("n_links"), "component_id"))
    forget(shards, labels, ends, found, classes)
    met = rows.drop("vec").join(named, told, "left")
    alone = F.col("n_links").isNull()
    met = met.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return met.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return grouped(table(spark, sf_dir, "embeddings"))


#: DuckDB SQL for the query: all pairs of a label, and components by spreading the least id.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
c AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a),
m AS (SELECT a, min(b) AS component_id FROM c GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
