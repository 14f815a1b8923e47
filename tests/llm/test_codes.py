import hashlib
import math

import numpy as np
import pytest

from parlance.llm import codes
from tests.against_duckdb import from_duckdb, from_spark
from tests.llm.fixtures import SF


def test_registered_query_is_the_sql(spark):
    assert from_spark(codes.query(spark, SF)) == from_duckdb(codes.SQL, SF)


def brute(rows):
    """The codes by plain Python integers, every part against every entry: (vec_id, code, error, label_error, sha)."""
    kept = [(i, [math.floor(256 * x) for x in v], a) for i, v, a in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 16
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v, _ in kept[:64]] for p in range(16)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((apart(part(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(2):
        for p in range(16):
            mine = {}
            for _, v, _ in kept:
                mine.setdefault(near(v, p)[1], []).append(part(v, p))
            for k, own in mine.items():
                books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, a, [near(v, p) for p in range(16)]) for i, v, a in kept]
    total = {}
    for _, a, found in out:
        total[a] = total.get(a, 0) + sum(d for d, _ in found)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), total[a], sha) for i, a, found in out), key=repr)


def frame(spark, rows, kind="array<double>"):
    return spark.createDataFrame([(i, v, a) for i, v, a in rows], f"vec_id long, embedding {kind}, label int").selectExpr("*", "'x' as code", "'y' as error", "1 as ints", "2 as d")


def got(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("many", [10, 64, 150])
def test_awkward_rows_against_plain_python(spark, many):
    """Ties, repeated rows, null ids and labels, unusable vectors, and fewer rows than entries."""
    r = np.random.default_rng(many)
    nan = float("nan")
    rows = [(int(i) if i % 11 else None, [float(x) for x in r.integers(-3, 4, 32) / 128], int(i) % 3 if i % 5 else None) for i in range(many)]
    rows += [(5, rows[4][1], 1), (5, rows[4][1], 1), (7, [0.0] * 32, None), (1, None, 1), (2, [nan] * 32, 1), (3, [None] + [0.1] * 31, 1), (4, [float("inf")] * 32, 1), (8, [], 1)]
    assert got(codes.compressed(frame(spark, rows))) == brute(rows)


def test_other_lengths_are_dropped_and_odd_ones_filled(spark):
    rows = [(i, [i / 7 - j / 3 for j in range(20)], 1) for i in range(70)]
    filled = [(i, v + [0.0] * 12, a) for i, v, a in rows]
    assert got(codes.compressed(frame(spark, [*rows, (99, [1.0] * 5, 1)]))) == brute(filled)


def test_bounds_hold_and_filter():
    r = np.random.default_rng(3)
    entries, asked = r.integers(-150, 150, (64, 6)), r.integers(-220, 220, (500, 6))
    cells = codes.Cells(entries)
    low, up = cells.bounds(asked)
    exact = ((asked[:, None] - entries) ** 2).sum(2)
    assert (low <= exact).all() and (exact <= up).all()
    assert (low <= up.min(1)[:, None]).mean() < 0.5  # most entries are never compared
    best, error = cells.nearest(asked)
    assert (best == exact.argmin(1)).all() and (error == exact.min(1)).all()


def test_empty_table(spark):
    assert codes.compressed(frame(spark, [])).collect() == []
    assert codes.compressed(frame(spark, [(1, None, 1)])).collect() == []


def test_huge_components_fit(spark):
    rows = [(i, [3e38 * (-1) ** i] * 16, i) for i in range(70)]
    found = codes.compressed(frame(spark, rows, "array<float>")).collect()
    assert len(found) == 70 and all(r["error"] >= 0 for r in found)
