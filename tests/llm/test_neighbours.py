import math

import numpy as np

from parlance.llm import neighbours
from tests.llm.fixtures import SF


def brute(vectors: dict, every: int, nearest: int):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % every == 0:
            s = x @ v
            out[i] = [(ids[j], s[j]) for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j])) if ids[j] != i][:nearest]
    return out


def recall(got, wanted) -> float:
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for q, own in wanted.items():
        rows = sorted(found.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(own) + 1))
        assert all((-a["score"], a["vec_id"]) < (-b["score"], b["vec_id"]) for a, b in zip(rows, rows[1:], strict=False))
        hits += len({r["vec_id"] for r in rows} & {v for v, _ in own})
        total += len(own)
    return hits / total


def test_recall_of_registered_query(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    wanted = brute(vectors, 20, 20)
    got = neighbours.query(spark, SF).collect()
    assert recall(got, wanted) >= 0.9
    exact = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    assert all(math.isclose(exact[q, v], s, rel_tol=1e-9, abs_tol=1e-9) for q, own in wanted.items() for v, s in own if (q, v) in exact)


def test_recall_of_clustered_vectors_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "INDEX_BLOCK", 700)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 40)
    r = np.random.default_rng(5)
    centres = r.normal(size=(30, 32))
    x = centres[r.integers(0, 30, 3000)] + 0.4 * r.normal(size=(3000, 32))
    rows = neighbours.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    index, books, n = neighbours.indexed(rows)
    got = neighbours.search(index, books, n, rows, rows.where("vec_id % 20 = 0")).collect()
    assert recall(got, brute(dict(enumerate(x)), 20, 20)) >= 0.9


def test_squared_distances(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 8))
    rows = neighbours.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    index, books, n = neighbours.indexed(rows)
    got = neighbours.search(index, books, n, rows, rows.where("vec_id % 20 = 0"), 5, "l2").collect()
    wanted = {i: [(j, -((x[i] - x[j]) ** 2).sum()) for j in sorted(range(400), key=lambda j: ((x[i] - x[j]) ** 2).sum()) if j != i][:5] for i in range(0, 400, 20)}
    assert recall(got, wanted) >= 0.9


def test_unusable_vectors_ties_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [-1.0, 2.0]), (None, [1.0, 1.0]), (8, [-1.0, 2.0]), (9, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as score", "'y' as norm", "1 as rank")
    use = neighbours.usable(df, "vec_id", "embedding")
    index, books, n = neighbours.indexed(use)
    got = neighbours.search(index, books, n, use, use.where("vec_id % 20 = 0")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 8, -1.0)]


def test_empty_table(spark):
    use = neighbours.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    index, books, n = neighbours.indexed(use)
    assert neighbours.search(index, books, n, use, use).count() == 0


def found(spark, x, nearest=20):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = neighbours.usable(df, "vec_id", "embedding")
    index, books, n = neighbours.indexed(rows)
    return neighbours.search(index, books, n, rows, rows.where("vec_id % 20 = 0"), nearest).collect()


def test_nothing_is_lost_whatever_the_rows_are_like(spark, monkeypatch):
    """Rows that the codebooks fit badly (many dimensions), very long and very short ones, and families of near copies."""
    monkeypatch.setattr(neighbours, "INDEX_BLOCK", 900)
    r = np.random.default_rng(7)
    wide = r.normal(size=(1500, 320))
    families = np.repeat(r.normal(size=(60, 24)), 25, axis=0) + 0.02 * r.normal(size=(1500, 24))
    for x in (wide, 1e25 * r.normal(size=(400, 16)), 1e-8 * r.normal(size=(400, 16)), families * np.exp(2 * r.normal(size=(1500, 1)))):
        assert recall(found(spark, x), brute(dict(enumerate(x)), 20, 20)) == 1


def test_copies_of_one_vector_are_dealt_a_bounded_number_of_times(spark):
    r = np.random.default_rng(8)
    x = np.concatenate([np.repeat(r.normal(size=(1, 8)), 300, axis=0), r.normal(size=(200, 8))])
    got = found(spark, x, 5)
    assert recall(got, brute(dict(enumerate(x)), 20, 5)) == 1
    rows = neighbours.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    index, _, n = neighbours.indexed(rows)
    assert index.count() == n == 500
    assert sorted(v["vec_id"] for v in neighbours.first_copies(index, 6).collect()) == [*range(6), *range(300, 500)]
