"""Audit of how far the sources of a language differ in their words, by wide term vectors.

Texts become counts of (lang, source, term) inside tasks, summed before and after one shuffle. Each term that enough
documents of its language have is then pivoted into one row with an array over the language's sources. Higher-order
functions turn the counts into shares and emit the contribution of every pair of sources; these are summed map-side. All
numbers are integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, keep, small
from .words import slices

#: Documents of its language that a term must be in; what is added to each count; parts that shares are counted in; ranks of terms.
LEAST_DOCS, SMOOTH, PARTS, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of text that are counted at once.
SLICE = 16 << 20

#: Bytes of terms: letters of ASCII, lower-cased, and all of other code points; 0 for the rest.
LETTER = np.arange(256, dtype=np.uint8)
LETTER[65:91] += 32
LETTER[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0


def terms(data: np.ndarray, text: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of a slice's texts (bytes, n+1 offsets), one after the other, and the n+1 offsets of the texts among them."""
    low = LETTER[data]
    inside = low != 0
    cut = np.zeros(len(data) + 1, bool)
    cut[text] = True
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1] | cut[1:-1]
        last[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    off = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(low[inside])))
    return found, np.searchsorted(start, text)


def counted(rows: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) of rows (lang, source, text): occurrences, and documents that have the term. A
    slice gives one row a group and term; equal ones of several slices are still to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources = (batch.column(k).dictionary_encode() for k in (0, 1))
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            for i, data, off in slices(batch.column(2), SLICE):
                found, of = terms(data, off)
                coded = found.dictionary_encode()
                many = max(len(coded.dictionary), 1)
                row = np.repeat(np.arange(len(off) - 1), np.diff(of))
                each, times = np.unique(row * many + coded.indices.to_numpy(), return_counts=True)
                key, at = np.unique(group[i + each // many] * many + each % many, return_inverse=True)
                count, docs = np.bincount(at, times, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
                g = key // many
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(g // len(sources.dictionary))), sources.dictionary.take(pa.array(g % len(sources.dictionary))), coded.dictionary.take(pa.array(key % many)).cast(pa.string()), pa.array(count), pa.array(docs)],
                    names=["lang", "source", "term", "count", "docs"],
                )

    return rows.mapInArrow(run, "lang string, source string, term string, count long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(PARTS * (count + SMOOTH) / (total + SMOOTH * terms)), exact for any count: in longs where the product fits."""
    under = total + terms * SMOOTH
    div = lambda kind: F.call_function("div", (count + SMOOTH).cast(kind) * F.lit(PARTS).cast("decimal(10,0)" if "dec" in kind else kind), under.cast(kind))
    return F.when(count < 9_000_000_000, div("long")).otherwise(div("decimal(27,0)")) + 1


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank), see the module; null text, lang and source count as ''.

    Terms are longest runs of A-Z, a-z and code points from 0x80 on, only A-Z lower-cased; those in at least `least`
    documents of a language are kept for it. Part `pair`: for each source of a language every other one as item, the value
    being the sum of |p - q| over the kept terms (0 without any). Part `term`: the `top` terms that a source has with a
    greater share than its language, the value being the difference. Ranks go by value, then by the item's UTF-8 bytes. Rows
    may repeat; each counts. Empty texts have no terms, but their groups stay; texts of any length are counted whole. Other
    columns play no part, whatever their names. No rows give no rows. A row a language with arrays over its sources is the
    widest that a task holds."""
    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sums = keep(counted(named).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")))
    often = keep(sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term"))
    wide = sums.join(small(often), ["lang", "term"], "left_semi").groupBy("lang", "term").agg(F.collect_list(F.struct("source", "count")).alias("own"))
    wide = keep(wide)
    forget(sums, often)
    groups = named.select("lang", "source").distinct()
    occurring = wide.select("lang", F.explode("own").alias("o")).groupBy("lang", F.col("o.source").alias("source")).agg(F.sum("o.count").alias("total"))
    totals = groups.join(occurring, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("total", F.lit(0).cast("long")).alias("total")).alias("s"))
    kept_terms = wide.groupBy("lang").agg(F.count("*").alias("terms"))
    langs = totals.groupBy("lang").agg(F.sort_array(F.collect_list("s")).alias("s")).join(kept_terms, "lang", "left")
    langs = langs.select("lang", F.col("s.source").alias("sources"), F.col("s.total").alias("totals"), F.aggregate("s.total", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.coalesce("terms", F.lit(0).cast("long")).alias("terms"))
    langs = keep(langs)

    met = wide.join(small(langs), "lang")
    count = lambda s: F.coalesce(F.get("own.count", F.array_position("own.source", s).cast("int") - 1), F.lit(0).cast("long"))
    met = met.withColumn("counts", F.transform("sources", count))
    all_counts = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    shares = F.zip_with("counts", "totals", lambda c, n: share(c, n, F.col("terms")))
    # kept, since a plan would work out the shares anew for each pair that reads them
    vectors = keep(met.select("lang", "term", "sources", "counts", shares.alias("p"), share(all_counts, F.col("total"), F.col("terms")).alias("q")))
    forget(wide)

    each = lambda p: F.flatten(F.transform(F.sequence(F.lit(0), F.size("sources") - 2), lambda i: F.transform(F.sequence(i + 1, F.size("sources") - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), p(i, j).alias("f")))))
    several = F.size("sources") > 1
    apart = vectors.where(several).select("lang", F.explode(each(lambda i, j: F.abs(F.get("p", i) - F.get("p", j)))).alias("e"))
    none = langs.where(several).select("lang", F.explode(each(lambda i, j: F.lit(0).cast("long"))).alias("e"))  # languages without kept terms have pairs too
    pairs = apart.unionByName(none).groupBy("lang", "e.i", "e.j").agg(F.sum("e.f").alias("value"))
    ways = F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))
    pairs = pairs.join(small(langs.select("lang", "sources")), "lang").select("lang", "sources", "value", F.explode(ways).alias("w"))
    pairs = pairs.select("lang", F.get("sources", F.col("w.a")).alias("source"), F.lit("pair").alias("part"), F.get("sources", F.col("w.b")).alias("item"), "value")

    above = F.filter(F.zip_with(F.arrays_zip("sources", "counts"), "p", lambda s, p: F.struct(s["sources"].alias("source"), s["counts"].alias("count"), (p - F.col("q")).alias("f"))), lambda x: (x["count"] > 0) & (x["f"] > 0))
    words = vectors.select("lang", "term", F.explode(above).alias("x")).select("lang", F.col("x.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), F.col("x.f").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(words.withColumn("rank", rank).where(F.col("rank") <= top))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return audit(table(spark, sf_dir, "documents"))


#: DuckDB SQL for the query: the same rows by plain counts of each group and term.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{80}-\x{10FFFF}]+') AS found FROM documents),
t AS (
  SELECT r, lang, source, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT r, lang, source, unnest(found) AS raw FROM d)),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
n AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON g.lang = k.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM n GROUP BY lang, source),
p AS (SELECT n.*, 1 + (1000000000 * (n + 5)) // (total + 5 * v) AS p FROM n JOIN s USING (lang, source) JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM n GROUP BY lang, term),
q AS (SELECT l.*, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + 5 * v) AS q FROM l JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item,
    coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.term = y.term AND x.lang = y.lang
      WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
words AS (SELECT p.lang, p.source, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM words)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
