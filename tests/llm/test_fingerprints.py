import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from parlance.llm import fingerprints as fp
from tests.llm.fixtures import SF, awkward, docs, prose


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def likeness(a: str, b: str) -> float:
    (ba, fa, ca), (bb, fb, cb) = a.split(":"), b.split(":")
    for x, y, on in ((fa, fb, ba == bb), (fa, cb, int(ba) == 2 * int(bb)), (ca, fb, 2 * int(ba) == int(bb))):
        if on:
            return 1 - edit_distance(x, y) / max(len(x), len(y), 1)
    return 0.0


def test_likeness_is_the_edit_distance():
    r = random.Random(1)
    texts = [prose(k, r.randrange(1, 900)) for k in range(30)]
    texts += [t[: len(t) // 2] + "zz" + t[len(t) // 2 :] for t in texts] + ["", "a", "ab"]
    prints = fp.signatures([t.encode() for t in texts]).strings()
    pairs = [(a, b) for a in prints for b in r.sample(prints, 12)]
    got = fp.likeness(fp.parse([a for a, _ in pairs]), fp.parse([b for _, b in pairs]))
    assert np.allclose(got, [likeness(a, b) for a, b in pairs])
    assert all(likeness(prints[k], prints[k + 30]) > 0.5 for k in range(30) if len(texts[k]) > 3000)


MASK, MULT = (1 << 64) - 1, 0x9E3779B97F4A7C15


def mixed(x: int) -> int:
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def signature(raw: bytes) -> str:
    """The fingerprint of one text, byte by byte, with whole numbers."""

    def rolled(i: int) -> int:
        h = sum((raw[i - k] + 1) * pow(0x01000193, k + 1, 1 << 32) for k in range(7)) & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x2C1B3C6D & 0xFFFFFFFF
        return h ^ h >> 13

    def ends(block: int) -> list[int]:
        return [i + 1 for i in range(6, len(raw)) if rolled(i) % block == 0]

    def text(stops: list[int]) -> str:
        stops = stops[:63]
        stops += [len(raw)] if not stops or stops[-1] != len(raw) else []
        out = ""
        for a, b in zip([0, *stops], stops):
            h, power = b - a, 1
            for x in raw[a:b]:
                h, power = (h + (x + 1) * power) & MASK, power * MULT & MASK
            out += chr(fp.ALPHABET[mixed(h) >> 58])
        return out

    if not raw:
        return "4::"
    block = 4
    while block * 64 < len(raw):
        block *= 2
    while block > 4 and len(ends(block)) < 16:
        block //= 2
    return f"{block}:{text(ends(block))}:{text(ends(2 * block))}"


def test_signatures_against_brute_force():
    texts = ["", "a", "abcdefg", "x" * 3000, "word " * 400, prose(1, 3), prose(2, 40), prose(3, 700), "naïve Ünïcødé 漢字 " * 9, "ab" * 40 + prose(4, 60) + "z" * 900]
    assert fp.signatures([t.encode() for t in texts]).strings() == [signature(t.encode()) for t in texts]


def wanted(rows):
    out = []
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        a, b, c = fp.signatures([text.encode(), edited.encode(), after.encode()]).strings()
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return out


def same(got, want):
    got, want = (sorted((tuple(r) for r in x), key=repr) for x in (got, want))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want])


def test_many_rows_without_a_key_or_with_one_key(spark, monkeypatch):
    """Over many small ranges: nulls come last, and equal keys are in the order of a hash of their text."""
    monkeypatch.setattr(fp, "RANGE", 2000)
    monkeypatch.setattr(fp, "A_RANGE", 1)
    rows = [(None, prose(i, 20 + i % 30), None, None) for i in range(120)] + [(7, prose(i + 500, 25), None, None) for i in range(80)] + [(i, prose(i + 900, 15), None, None) for i in range(60)]
    rows += [(None, prose(3, 30), None, None)] * 20 + [(9, None, None, None), (None, None, None, None), (-5, "", None, None)]
    df = docs(spark, rows)
    order = [(r["doc_id"], r["text"]) for r in df.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text")).collect()]
    assert fp.in_order(df, "doc_id", "text").rdd.getNumPartitions() > 20
    same(fp.with_next(df).collect(), wanted(order))


def test_registered_query_against_brute_force(spark):
    rows = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    same(fp.query(spark, SF).collect(), wanted(rows))


def test_awkward_rows(spark):
    got = fp.with_next(docs(spark)).collect()
    assert len(got) == len(awkward())
    assert sorted(r["n_chars"] for r in got) == sorted(len(r[1] or "") for r in awkward())
    plain = {}
    for r in docs(spark).select("doc_id", fp.fingerprint(F.col("text")).alias("f")).collect():
        plain.setdefault(r["doc_id"], set()).add(r["f"])
    assert all(r["fingerprint"] in plain[r["doc_id"]] for r in got)
    assert plain[1] == plain[2] and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got)


def test_one_row_and_none(spark):
    one = fp.with_next(docs(spark, [(4, "abcdef", None, None)])).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one[0]["near_next"] == 1.0
    assert fp.with_next(docs(spark, [])).count() == 0
