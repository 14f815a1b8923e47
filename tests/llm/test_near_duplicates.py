import random
import re

import numpy as np
import pytest

from parlance.llm import neardup
from parlance.llm.components import components
from tests.llm.fixtures import SF, awkward, docs, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    """component_id of each row, all pairs compared."""
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(key)
    least = {g: min((x for x in keys if x is not None), default=None) for g, keys in groups.items()}
    return [(key, len(sets[i]), key if not sets[i] else least[find(i)]) for i, (key, _) in enumerate(rows)]


def same(spark, df, rows, k):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.grouped(df, k=k).collect()), key=repr)
    assert got == sorted(brute(rows, k, 80), key=repr)


def test_awkward_rows(spark):
    same(spark, docs(spark), [(r[0], r[1]) for r in awkward()], 2)


def test_empty_table(spark):
    assert neardup.grouped(docs(spark, [])).count() == 0
    assert neardup.deduplicated(docs(spark, [])).columns == docs(spark, []).columns


def test_registered_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in neardup.query(spark, SF).collect())
    assert got == sorted((i, n, c, i == c) for i, n, c in brute(rows, 2, 80))


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_and_edited_copies(spark, seed):
    r = random.Random(seed)
    rows = []
    for family in range(6):
        words = prose(100 * seed + family, 90).split()
        for step in range(12):
            words = list(words)
            for _ in range(2):
                words[r.randrange(len(words))] = f"w{family}x{step}"
            rows.append((len(rows), " ".join(words), "en", "web"))
    same(spark, docs(spark, rows), [(i, t) for i, t, _, _ in rows], 2)


def test_one_of_each_group_stays(spark):
    kept = neardup.deduplicated(docs(spark), k=5).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids and 4 not in ids
    assert {5, 6, 7, 8, 9, 10} <= set(ids) and 15 not in ids
    assert kept[0].asDict()["score"] == "mine"


def test_a_key_that_repeats_with_other_texts(spark):
    """No text that is like none other may go, and every row without words stays."""
    one, two, three = prose(61, 80), prose(62, 80), prose(63, 80)
    rows = [(1, one, "en", "a"), (2, one + " more", "en", "a"), (2, two, "en", "a"), (2, two, "en", "a"), (3, three, "en", "a"), (3, prose(64, 80), "en", "a")]
    rows += [(4, None, "en", "a"), (4, " ", "en", "a"), (4, " ", "en", "a"), (None, None, "en", "a"), (None, None, "en", "b"), (None, three, "en", "a")]
    same(spark, docs(spark, rows), [(i, t) for i, t, _, _ in rows], 5)
    got = sorted(((r["doc_id"], r["text"]) for r in neardup.deduplicated(docs(spark, rows), k=5).collect()), key=repr)
    assert got == sorted([(1, one), (2, two), (3, three), (3, rows[5][1]), (4, None), (4, " "), (4, " "), (None, None), (None, None)], key=repr)


def test_sketch_of_a_set_estimates_likeness():
    r = np.random.default_rng(0)
    both, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
    s = neardup.sketch(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), 1024)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.06


def test_components(spark):
    r = random.Random(3)
    edges = [(f"{r.randrange(60):03d}", f"{r.randrange(60):03d}") for _ in range(45)] + [(f"{i:03d}", f"{i + 1:03d}") for i in range(70, 110)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == root


def test_few_tables_are_written(spark, monkeypatch):
    """Each table that is written costs its tasks a file each and the executors the processes that set files' rights."""
    written = []

    def counted(df):
        written.append(df.columns)
        return keep(df)

    keep = neardup.keep
    monkeypatch.setattr(neardup, "keep", counted)
    monkeypatch.setattr("parlance.llm.components.keep", counted)
    components(spark.createDataFrame([("b", "a"), ("c", "a"), ("e", "d")], "a string, b string"))
    assert len(written) == 1  # stars as they are
    words = prose(9, 90).split()
    rows = [(i, " ".join(words[:i] + [f"new{i}"] + words[i:]), "en", "web") for i in range(0, 90, 3)] + [(100 + i, prose(200 + i, 60), "en", "web") for i in range(20)]
    written.clear()
    same(spark, docs(spark, rows), [(i, t) for i, t, _, _ in rows], 2)
    assert len(written) <= 13
