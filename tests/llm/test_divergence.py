import re
from collections import Counter, defaultdict

import duckdb

from parlance.llm import divergence
from tests.against_duckdb import from_duckdb, from_spark, ordered
from tests.llm.fixtures import SF, WORDS, docs, prose


def test_registered_query_is_the_sql(spark):
    assert from_spark(divergence.query(spark, SF)) == from_duckdb(divergence.SQL, SF)


def brute(rows, least, top):
    """The audit word by word in plain Python: (lang, source, part, item, value, rank)."""
    counts, docs_of, groups = defaultdict(Counter), defaultdict(Counter), set()
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [t.translate(low) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(found)
        docs_of[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs_of[lang].items() if n >= least]
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, whole = share(counts[lang, source]), share(sum((counts[g] for g in groups if g[0] == lang), Counter()))
        pairs = [(s, sum(abs(p[t] - q[t]) for t in kept)) for a, s in groups if a == lang and s != source for q in [share(counts[lang, s])]]
        terms = [(t, p[t] - whole[t]) for t in kept if counts[lang, source][t] and p[t] > whole[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]):
                out.append((lang, source, part, item, value, k + 1))
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_awkward_rows_against_plain_python(spark):
    """Nulls, empty and long texts, a hot source, one with no terms, a language with one source, ties and odd letters."""
    rows = [(i, f"{prose(i % 7, 30)} ÉCLAIR Éclair naïve 漢字かな x{i} {WORDS[i % 5].upper()}", "en", "hot" if i % 3 else f"s{i % 5}") for i in range(80)]
    rows += [(i, prose(i, 12), "de", None) for i in range(6)] + [(None, None, "de", "empty"), (1, "", "de", "none"), (2, " 12 ?\u0000\n", "de", "none")]
    rows += [(3, "alone", None, None), (3, "alone", None, None), (4, prose(9, 20000), "en", "long"), (5, "a" * 50000 + " B", "en", "long")]
    assert rows_of(divergence.audit(docs(spark, rows), least=4, top=7)) == brute(rows, 4, 7)


def test_slices_do_not_matter(spark, monkeypatch):
    rows = [(i, prose(i, 25), "en", f"s{i % 3}") for i in range(60)]
    monkeypatch.setattr(divergence, "SLICE", 100)
    assert rows_of(divergence.audit(docs(spark, rows), least=3)) == brute(rows, 3, 50)


def test_language_without_kept_terms_has_pairs(spark):
    got = rows_of(divergence.audit(docs(spark, [(1, "one", "en", "a"), (2, None, "en", "b")])))
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_counts_beyond_longs(spark):
    from pyspark.sql import functions as F

    counts = [0, 8_999_999_999, 9_000_000_000, 10**13, 10**17]
    df = spark.createDataFrame([(c, 10**17 + c, 123_456) for c in counts], "c long, n long, v long")
    got = [r[0] for r in df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 5) // (10**17 + c + 5 * 123_456) for c in counts]


def test_empty_table(spark):
    assert rows_of(divergence.audit(docs(spark, []))) == []


def test_sql_also_on_nulls(spark):
    rows = [(i, prose(i % 9, 20), "en", f"s{i % 4}" if i % 4 else None) for i in range(70)] + [(1, None, None, "x")]
    df = docs(spark, rows)
    con = duckdb.connect()
    con.register("documents", df.select("text", "lang", "source").toPandas())
    sql = con.execute(divergence.SQL)
    assert from_spark(divergence.audit(df)) == ordered([c[0] for c in sql.description], sql.fetchall())
