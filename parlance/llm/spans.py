"""Substring dedup by sliding sentence spans: every run of RUN consecutive sentences is hashed and joined globally."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, forget, fresh, keep, whole_number, without
from .words import Prefix, U, Words, mix, scan, shingles, slices

RUN = 3
#: Sentences of more words are taken in pieces of so many words at most, so that 51 words of any text hold a span.
LONG_SENTENCE = 12

_END = np.zeros(256, bool)
_END[[*b".!?"]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[*b"\"')]"]] = True


class Sentences(NamedTuple):
    first: np.ndarray  # of each sentence, its first word
    last: np.ndarray  # one past its last word
    of: np.ndarray  # n+1 sentence offsets of the texts


def least_of_window(values: np.ndarray, part: np.ndarray, width: int) -> np.ndarray:
    """Which values are the least, the last one of equals, of some `width` consecutive ones of one part."""
    picked = np.zeros(len(values), bool)
    if len(values) >= width:
        at = np.arange(len(values) - width + 1)
        at = at[part[at] == part[at + width - 1]]
        best, value = at.copy(), values[at]
        for k in range(1, width):
            less = values[at + k] <= value
            best[less], value[less] = at[less] + k, values[at[less] + k]
        picked[best] = True
    return picked


def sentences(w: Words, longest: int = LONG_SENTENCE) -> Sentences:
    """A sentence ends with a word that ends in . ! ? (and a closing mark, or one of four marks of other scripts), at a
    line break and at the end of the text.

    Text without marks, and sentences of more than `longest` words, are cut by their content: every word that has the
    least hash of some `longest` consecutive words of the sentence ends a piece, which then counts as a sentence. Equal
    sentences are cut alike, and so are equal passages but for the words at their ends; no piece is longer."""
    n = len(w.start)
    if not n:
        return Sentences(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(w.of), np.int64))
    size = w.end - w.start
    one = w.data[w.end - 1]
    two = np.where(size > 1, w.data[np.maximum(w.end - 2, 0)], 0)
    three = np.where(size > 2, w.data[np.maximum(w.end - 3, 0)], 0)
    stop = _END[one] | (_CLOSE[one] & _END[two])
    stop |= ((two == 0xD8) & (one == 0x9F)) | ((two == 0xDB) & (one == 0x94))  # Arabic question mark and full stop
    stop |= ((three == 0xE2) & (two == 0x80) & (one == 0xA6)) | ((three == 0xE3) & (two == 0x80) & (one == 0x82))  # ellipsis, ideographic stop
    lines = np.concatenate([[0], np.cumsum(w.data == 10)])
    stop[:-1] |= lines[w.start[1:]] > lines[w.end[:-1]]
    stop[w.of[1:][np.diff(w.of) > 0] - 1] = True
    last = np.flatnonzero(stop) + 1
    many = np.diff(np.concatenate([[0], last]))
    number = np.repeat(np.arange(len(last)), many)
    stop |= np.repeat(many > longest, many) & least_of_window(w.hash, number, longest)
    last = np.flatnonzero(stop) + 1
    first = np.concatenate([[0], last[:-1]])
    return Sentences(first, last, np.searchsorted(first, w.of))


def span_hashes(w: Words, s: Sentences, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each text's spans, independent from the words on, and the texts' offsets among them; a text of fewer
    than `run` sentences is one span."""
    of_words = lambda h: Words(w.first, w.data, w.text, s.first, s.last, Prefix(h)(s.first, s.last), s.of)
    one, of = shingles(of_words(w.hash), run)
    two, _ = shingles(of_words(mix(w.hash ^ U(0x5851F42D4C957F2D))), run)
    return one, two, of


def all_spans(texts: DataFrame, run: int, longest: int) -> DataFrame:
    """(span, check, key, hash, pos): every span of every text (key, hash, text); span and check are two hashes of its words."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, off in slices(batch.column(2)):
                w = scan(data, off, first)
                one, two, of = span_hashes(w, sentences(w, longest), run)
                rows = np.repeat(np.arange(first, first + len(off) - 1), np.diff(of))
                at = pa.array(rows)
                pos = np.arange(len(one)) - of[rows - first]
                cols = [pa.array(one.view(np.int64)), pa.array((two >> U(32)).astype(np.uint32).view(np.int32)), batch.column(0).take(at), batch.column(1).take(at), pa.array(pos.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["span", "check", "key", "hash", "pos"])

    return texts.select("key", "hash", "text").mapInArrow(found, "span long, check int, key long, hash long, pos int")


def repeated(spans: DataFrame) -> DataFrame:
    """(key, hash, later), kept: for each text the numbers of its spans that are not the first of their kind. The first is the
    one with the least key (null keys come last), then the least hash of its text, then the least place in it."""
    kind = ["span", "check"]
    # the sums are kept before they are joined, so that Spark may split the join's partition of a very frequent span
    many = keep(spans.groupBy(*kind).agg(F.count("*").alias("n"), F.min("key").alias("least")).where("n > 1").drop("n"))
    hits = keep(spans.join(many, kind))
    forget(many)
    start = keep(hits.where(F.col("key").eqNullSafe(F.col("least"))).groupBy(*kind).agg(F.min(F.struct("hash", "pos")).alias("first")))
    is_first = F.col("key").eqNullSafe(F.col("least")) & (F.struct("hash", "pos") == F.col("first"))
    found = keep(hits.join(start, kind).where(~is_first).groupBy("key", "hash").agg(F.collect_set("pos").alias("later")))
    forget(hits, start)
    return found


def cut(text: str, later: list[int] | None, run: int, longest: int = LONG_SENTENCE) -> tuple[str, int]:
    """A text without the sentences that the given spans cover (None: all), and the words that went. A removed stretch
    takes the white space after it along, but leaves a line break that parts lines."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    w = scan(data, np.array([0, len(data)]))
    s = sentences(w, longest)
    gone = np.zeros(len(s.first) + 1, np.int64)
    for p in [0] if later is None else later:
        gone[p] += 1
        gone[len(s.first) if later is None else min(p + run, len(s.first))] -= 1
    on = np.flatnonzero(np.cumsum(gone)[:-1] > 0)
    if not len(on):
        return text, 0
    breaks = np.flatnonzero(np.diff(on) > 1)
    kept, words, at = [], 0, 0
    for a, b in zip(on[np.concatenate([[0], breaks + 1])], on[np.concatenate([breaks, [len(on) - 1]])], strict=True):
        start = int(w.start[s.first[a]])
        end = int(w.start[s.last[b]]) if s.last[b] < len(w.start) else len(raw)
        kept.append(raw[at:start])
        if b"\n" in raw[int(w.end[s.last[b] - 1]) : end] and start > 0 and raw[start - 1] != 10:
            kept.append(b"\n")
        words, at = words + int(s.last[b] - s.first[a]), end
    kept.append(raw[at:])
    return b"".join(kept).decode(), words


def deduplicated(docs: DataFrame, run: int = RUN, key: str = "doc_id", text: str = "text", count: str = "removed_words", longest: int = LONG_SENTENCE) -> DataFrame:
    """docs with repeated passages cut out of text, and removed_words long (or what `count` names it).

    Sentences of up to `longest` words count whole, longer ones by pieces. The default makes any passage of 51 words hold a
    span, whatever its sentences; with 50, sentences of up to 50 words are only removed whole, and a passage is found if it
    holds three of them. A text of fewer than `run` sentences is one span.

    A sentence goes if a span of `run` consecutive sentences that covers it occurred before, however short it is. Word case
    (A-Z) and white space make no difference. The first occurrence stays whole; among texts with keys it is in the one with
    the least key, and texts without a key come after all others. Rows may share a key: texts are told apart by key and
    text, and of rows that are equal in both one keeps what is first of its kind while the others are emptied. Null, empty
    and blank texts stay as they are, with 0. Texts of any length are taken whole. Other columns stay as they are, but one
    named like `count` is replaced. No rows give no rows."""
    base, number = without(docs, count), whole_number(docs, key)
    x = fresh(docs, "key", "hash", "k", "h", "later", "extra", "row", "one", "text")
    spans = keep(all_spans(base.select(number.alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("hash"), F.col(f"`{text}`").alias("text")), run, longest))
    base = base.withColumn(x.key, number).withColumn(x.hash, F.xxhash64(F.col(f"`{text}`")))
    marks = repeated(spans).select(F.col("key").alias(x.k), F.col("hash").alias(x.h), F.col("later").alias(x.later))
    base = base.withColumn(x.extra, F.lit(False))
    twice = keep(spans.where("pos = 0").groupBy("key", "hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias(x.k), F.col("hash").alias(x.h)))
    forget(spans)
    same = F.col(x.key).eqNullSafe(F.col(x.k)) & (F.col(x.hash) == F.col(x.h))
    if not twice.isEmpty():
        rows = keep(base.join(twice, same, "left_semi").withColumn(x.row, F.monotonically_increasing_id()))
        ones = rows.groupBy(F.col(x.key).alias(x.k), F.col(x.hash).alias(x.h)).agg(F.min(x.row).alias(x.one))
        told = rows.join(ones, same).withColumn(x.extra, F.col(x.row) != F.col(x.one))
        base = base.join(twice, same, "left_anti").unionByName(told.select(*base.columns))
    met = base.join(marks, same, "left").drop(x.key, x.hash, x.k, x.h)

    def make(texts: pa.Array, later: pa.Array, extra: pa.Array) -> list[pa.Array]:
        emptied = extra.to_numpy(zero_copy_only=False)
        marked = later.is_valid().to_numpy(zero_copy_only=False) | emptied
        if not marked.any():
            return [texts, pa.array(np.zeros(len(texts), np.int64))]
        out, words = texts.to_pylist(), np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(marked).tolist():
            out[i], words[i] = cut(out[i], None if emptied[i] else later[i].as_py(), run, longest)
        return [pa.array(out, texts.type), pa.array(words)]

    made = append(met, [text, x.later, x.extra], [T.StructField(x.text, T.StringType()), T.StructField(count, T.LongType())], make)
    return made.select(*(F.col(x.text).alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in without(docs, count).columns), f"`{count}`")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
