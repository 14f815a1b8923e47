"""Model calls behind one interface: text in, text out, as Arrow batches; deterministic stand-ins by default.

A scorer is a callable from a list of strings to a list of strings of the same length; None stands for a failed call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import text as X
from parlance.sources.folders import keep

Scorer = Callable[[list[str]], list[str | None]]


def scored(df: DataFrame, prompt: str, scorer: Scorer, out: str = "reply", attempts: int = 1) -> DataFrame:
    """df with the scorer's reply to the prompt column, null where it failed. Each row is scored once a run: the call is a
    map over partitions, which no later filter makes Spark repeat."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies: list[str | None] = [None] * len(batch)
            for _ in range(attempts):
                missing = [i for i, r in enumerate(replies) if r is None]
                if not missing:
                    break
                try:
                    for i, r in zip(missing, scorer([batch[prompt].iloc[i] or "" for i in missing]), strict=True):
                        replies[i] = r
                except ConnectionError:
                    continue
            batch[out] = pd.Series(replies, index=batch.index, dtype=object)
            yield batch

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def attempted(df: DataFrame, prompt: str, scorer: Scorer) -> DataFrame:
    """df with reply and failed. A model that is away (a connection error) gives a null reply that is not failed; any other
    error of a prompt, asked for alone if need be, is failed and has no reply."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prompts = [p or "" for p in batch[prompt]]
            try:
                got = [(r, False) for r in scorer(prompts)]
            except Exception:
                got = []
                for p in prompts:
                    try:
                        got.append((scorer([p])[0], False))
                    except ConnectionError:
                        got.append((None, False))
                    except Exception:
                        got.append((None, True))
            batch["reply"] = pd.Series([r for r, _ in got], index=batch.index, dtype=object)
            batch["failed"] = pd.Series([f for _, f in got], index=batch.index, dtype=bool)
            yield batch

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("reply", T.StringType()), T.StructField("failed", T.BooleanType())]))


def scored_distinct(df: DataFrame, prompt: str, scorer: Scorer, out: str = "reply") -> DataFrame:
    """As scored, but each distinct prompt is scored once."""
    once = scored(df.select(prompt).where(F.col(prompt).isNotNull()).distinct(), prompt, scorer, out)
    return df.join(once, prompt, "left")


_VOWELS = str.maketrans("aeiou", "AEIOU")


def capital_vowels(texts: list[str]) -> list[str | None]:
    """Stand-in for a translator."""
    return [t.translate(_VOWELS) for t in texts]


def ends_and_count(texts: list[str]) -> list[str | None]:
    """Stand-in for a summariser, whose reply shows what it was given: the first word, the last one, and how many there are."""
    words = [t.split() for t in texts]
    return [f"{w[0]} {w[-1]} {len(w)}" if w else "" for w in words]


def every_tenth(texts: list[str]) -> list[str | None]:
    """Stand-in for a boundary model: a statement ends at every tenth word of a numbered list."""
    return [", ".join(f"{i}:S" for i in range(9, len(t.split("\n")), 10)) for t in texts]


#: Words at which the unsteady stand-in is away, or fails.
AWAY, UNREADABLE = "(absent)", "(unreadable)"


def unsteady_tenth(texts: list[str]) -> list[str | None]:
    """Stand-in for a boundary model that is away for some lists and fails at others."""
    if any(UNREADABLE in t for t in texts):
        raise ValueError("cannot read this list")
    if any(AWAY in t for t in texts):
        raise ConnectionError("away")
    return every_tenth(texts)


def translated(transcript: DataFrame, scorer: Scorer = capital_vowels) -> DataFrame:
    """transcript (with task, src_lang, trg_lang) with has_translation and translation; rows of files that need none, or
    of blank text, are not scored."""
    needs = X.should_translate(F.col("task"), F.col("src_lang"), F.col("trg_lang"))
    marked = transcript.withColumn("has_translation", F.coalesce(needs, F.lit(False)))
    asked = marked.withColumn("__asked", F.when(F.col("has_translation") & ~X.is_blank(F.col("text")), F.col("text")))
    return scored_distinct(asked, "__asked", scorer, "translation").drop("__asked")


def tagged(scorer: Scorer) -> Scorer:
    """The scorer with `+` before each reply and `!` for a text that overflows its context, which the scorer tells by an
    error of such a message; the texts of a call that overflows are asked one by one."""

    def run(texts: list[str]) -> list[str | None]:
        try:
            return [None if r is None else "+" + r for r in scorer(texts)]
        except ConnectionError:
            return [None] if len(texts) == 1 else [r for t in texts for r in run([t])]
        except Exception as error:
            if not any(mark in str(error).lower() for mark in X.OVERFLOW):
                raise
            return ["!"] if len(texts) == 1 else [r for t in texts for r in run([t])]

    return run


def summarised(texts: DataFrame, budget: int, scorer: Scorer = ends_and_count, depth: int = 5, retries: int = 4, strict: bool = True) -> DataFrame:
    """(file_id, summary): texts packed to chunks of the budget, each summarised, the summaries joined by blank lines and
    taken again, for all files at once. A file is done when it fits one chunk; after `depth` reductions its leading chunk
    decides. A file of which a chunk overflows begins again with half its budget, `retries` times at most; its summary is
    empty if it still overflows, or if a call failed. Rounds are bounded by depth and retries, whatever the texts.

    An empty or null text is an error that names its file; unless `strict`, its summary is null and the other files' stand."""
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    missing = None
    if strict:
        error = F.raise_error(F.concat(F.lit("no text to summarise in file "), F.coalesce(F.col("file_id").cast("string"), F.lit("null"))))
        texts = texts.withColumn("text", F.when(empty, error.cast("string")).otherwise(F.col("text")))
    else:
        missing = texts.where(empty).select("file_id", F.lit(None).cast("string").alias("summary"))
        texts = texts.where(~empty)
    todo = texts.select("file_id", "text", F.lit(budget).alias("budget"), F.lit(0).alias("tries"), F.lit(0).alias("depth"))
    done = missing
    while True:
        chunks = todo.withColumn("chunks", X.packed(F.col("text"), F.col("budget")))
        chunks = chunks.withColumn("chunks", F.when(F.col("depth") >= depth, F.slice("chunks", 1, 1)).otherwise(F.col("chunks"))).withColumn("n", F.size("chunks"))
        each = chunks.select("file_id", "budget", "tries", "depth", "n", F.posexplode("chunks").alias("pos", "chunk"))
        replies = scored(each, "chunk", tagged(scorer))
        bad = F.when(F.col("reply").isNull(), "failed").when(F.col("reply") == "!", "overflow")
        joined = replies.groupBy("file_id").agg(
            *(F.max(c).alias(c) for c in ("budget", "tries", "depth", "n")),
            F.min(F.when(bad.isNotNull(), F.struct("pos", bad.alias("kind"))))["kind"].alias("bad"),  # the first one decides
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.substring("reply", 2, 1 << 30).alias("r")))), lambda p: p["r"]), "\n\n").alias("text"),
        )
        joined = keep(joined)  # no lost executor makes a model answer again
        again = (F.col("bad") == "overflow") & (F.col("tries") < retries)
        ended = joined.where((F.col("bad").isNotNull() & ~again) | (F.col("bad").isNull() & (F.col("n") == 1)))
        ended = ended.select("file_id", F.when(F.col("bad").isNull(), F.col("text")).otherwise("").alias("summary"))
        done = ended if done is None else done.unionByName(ended)
        todo = joined.where("bad is null and n > 1").select("file_id", "text", "budget", "tries", (F.col("depth") + 1).alias("depth"))
        over = joined.where(again)
        if not over.isEmpty():
            half = over.select(F.col("file_id").alias("__id"), F.greatest(F.lit(1), F.floor(F.col("budget") / 2)).cast("int").alias("budget"), (F.col("tries") + 1).alias("tries"))
            first = texts.select("file_id", "text").join(half, F.col("file_id").eqNullSafe(F.col("__id"))).select("file_id", "text", "budget", "tries", F.lit(0).alias("depth"))
            todo = todo.unionByName(first)
        elif todo.isEmpty():
            return done
