import numpy as np
import pytest

from parlance.llm import smallworld, vectordups
from tests.against_duckdb import from_duckdb, from_spark
from tests.llm.fixtures import SF


def test_registered_query_is_the_sql(spark):
    assert from_spark(vectordups.query(spark, SF)) == from_duckdb(vectordups.SQL, SF)


def brute(rows, least=0.93):
    """(vec_id, n_links, component_id, kept) by all pairs of rows."""
    fine = [v is not None and a is not None and all(x is not None and np.isfinite(x) for x in v) and any(v or []) for _, v, a in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None for (_, v, _), ok in zip(rows, fine, strict=True)]
    near = [[j for j in range(len(rows)) if j != i and fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(len(rows))]
    root = list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for i, own in enumerate(near):
            low = min([root[i], *(root[j] for j in own)])
            for j in [i, *own]:
                if root[j] > low:
                    root[j], moved = low, True
    least_id = {}
    for i, (key, _, _) in enumerate(rows):
        if key is not None:
            least_id[root[i]] = min(key, least_id.get(root[i], key))
    out = [(key, len(near[i]), least_id.get(root[i])) for i, (key, _, _) in enumerate(rows)]
    return sorted(((*o, o[0] == o[2]) for o in out), key=repr)


def frame(spark, rows, kind="array<double>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int").selectExpr("*", "'x' as node", "'y' as weight", "1 as shard", "2 as one", "3 as d", "4 as n_links")


def got(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def crowd(seed, sizes, d=16, spread=0.08):
    r = np.random.default_rng(seed)
    rows, at = [], 0
    for label, size in sizes:
        c = r.normal(size=d)
        for v in c + spread * r.normal(size=(size, d)):
            rows.append((at, [float(x) for x in v], label))
            at += 1
    return [rows[i] for i in r.permutation(len(rows))]


def test_awkward_rows_against_all_pairs(spark):
    """Nulls, zeros, repeated rows and ids, other lengths, scaled copies, an equal vector under another label."""
    nan, inf = float("nan"), float("inf")
    rows = crowd(1, [(1, 30), (1, 20), (2, 25), (None, 5), *[(1, 1)] * 40])
    v = rows[0][1]
    rows += [(500, v, 1), (500, v, 1), (None, v, 1), (501, [3 * x for x in v], 1), (502, v, 7), (503, v, None), (504, None, 1), (505, [0.0] * 16, 1), (506, [nan] * 16, 1), (507, [inf] * 16, 1), (508, [None] * 16, 1)]
    rows += [(509, [1.0, 2.0], 1), (510, [2.0, 4.0], 1), (511, [5.0], 1), (512, [-5.0], 1), (513, [], 1), (None, [9.0, -9.0], 3), (None, [9.0, -9.0], 3)]
    assert got(vectordups.grouped(frame(spark, rows))) == brute(rows)


def test_several_shards_and_beams_that_fill(spark, monkeypatch):
    """A group that is greater than any beam, groups that spread over shards, and single pairs; all links are found."""
    monkeypatch.setattr(vectordups, "SHARD_ROWS", 600)
    monkeypatch.setattr(vectordups, "WIDEST", 64)
    rows = crowd(2, [(1, 400), *[(1, 12)] * 20, *[(1, 2)] * 100, *[(1, 1)] * 700, (2, 90), *[(2, 1)] * 50])
    rows += [(10_000 + i, rows[0][1], rows[0][2]) for i in range(50)]
    assert got(vectordups.grouped(frame(spark, rows))) == brute(rows)


def test_floats_and_empty_table(spark):
    rows = [(i, [float(np.float32(x)) for x in v], a) for i, v, a in crowd(3, [(1, 40), (2, 10)])]
    assert got(vectordups.grouped(frame(spark, rows, "array<float>"))) == brute(rows)
    assert vectordups.grouped(frame(spark, [])).collect() == []


def test_chains_reach_across_shards(spark, monkeypatch):
    """Each vector is linked with the next only: one component, over more shards than one."""
    monkeypatch.setattr(vectordups, "SHARD_ROWS", 20)
    step = 0.3  # cos(0.3) = 0.955, cos(0.6) = 0.825
    rows = [(i, [float(np.cos(step * i)), float(np.sin(step * i))], 1) for i in range(10)]
    rows += [(100 + i, [0.0, 0.0, float(np.cos(step * i)), float(np.sin(step * i))], 1) for i in range(10)]
    found = got(vectordups.grouped(frame(spark, rows)))
    assert found == brute(rows) and {c for _, _, c, _ in found} == {0, 100}


def test_graph_finds_nearest_and_audit_rejects_a_broken_one():
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at, sizes = smallworld.order(np.arange(3000))
    x = x[at]
    graph = smallworld.build(x, sizes)
    ids, near = smallworld.search(graph, x, 48)
    assert (ids[:, 0] == np.arange(3000)).mean() > 0.99
    best = np.argsort(-(x @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(ids[:, :10].tolist(), best.tolist(), strict=True)]) >= 9.5
    none = np.zeros(3000, bool)
    assert vectordups.audit(graph, x, x, ids, none, 0.93, 48)
    broken = smallworld.Graph(graph.x, [np.full_like(graph.layers[0], 3000), *graph.layers[1:]])
    assert not vectordups.audit(broken, x, x, smallworld.search(broken, x, 48)[0], none, 0.93, 48)


@pytest.mark.parametrize("own", [True, False])
def test_a_broken_graph_widens_to_the_whole_shard(own):
    rows = crowd(5, [(1, 30), *[(1, 1)] * 400], d=12)
    x = vectordups.unit(np.array([v for _, v, _ in rows]))
    graph = smallworld.Graph(np.concatenate([x.astype(np.float32), np.zeros((1, 12), np.float32)]), [np.full((len(x), 24), len(x))])
    mine, theirs, root = vectordups.linked(graph, x, np.ones(len(x)), x, np.ones(len(x)), own, 0.93)
    link = x @ x.T >= 0.93
    if own:
        np.fill_diagonal(link, False)
        assert (mine + theirs == link.sum(1)).all()
    else:
        assert (mine == link.sum(1)).all() and (theirs == link.sum(0)).all()
    assert len(set(root.tolist())) == 401
