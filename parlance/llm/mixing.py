"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import before, fresh, keep, numbered, small, whole_number

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
#: Slices of the ratio: the one in which a source's sum crosses is found among FINE coarse ones, then among its FINE ones.
FINE = 256


def words(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def odds(draw: Column) -> Column:
    """Random odds u / (1 - u) of a row, from the MD5 of what tells it: the same in every run."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), draw)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return u / (1 - u)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): WEIGHTS by code point order of the source (null last),
    repeating, share all words; no target exceeds MOST times its source, the excess goes to the others by weight.

    A source stays below its limit exactly if its limit a weight exceeds the water level; in order of that ratio the
    limited ones come first, so running sums give the level. The sums run over ranges, however many sources there are."""
    name = F.col("source").asc_nulls_last()
    placed = before(sizes, [name], {"place": F.lit(1)})
    weighed = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("long"))
    weighed = weighed.withColumn("limit", F.col("source_size") * MOST).withColumn("share", F.col("limit") / F.col("weight"))
    # shares can tie; the order among equals has no effect on the level
    summed = keep(before(weighed, [F.col("share"), name], {"limited": F.col("limit"), "lighter": F.col("weight")}))
    total, weights = summed.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(total) - F.col("limited")).cast("double") / (F.lit(weights) - F.col("lighter")).cast("double")
    limit = F.col("limit").cast("double")
    water = summed.select(F.max(F.when(level * F.col("weight") <= limit, level))).first()[0]
    reached = limit if water is None else F.least(F.lit(water) * F.col("weight"), limit)
    return summed.select("source", "source_size", reached.alias("target"))


def importance(size: Column) -> Column:
    """How much more often a document is wanted than an empty one: by the order of magnitude of its words, in eighths."""
    return (7 + F.length(F.bin(F.greatest(size, F.lit(1))))).cast("long")


def crossing(ladder: DataFrame, rung: str, start: Column) -> DataFrame:
    """(source, edge, gap): of each source's rungs (at most FINE, with words) the first at which `start` words go out, and
    the words that are left before it. Sources whose words do not reach so far have no row."""
    climb = Window.partitionBy("source").orderBy(rung).rowsBetween(Window.unboundedPreceding, 0)
    upto = ladder.withColumn("gap", start - (F.sum("words").over(climb) - F.col("words"))).where(F.col("words") > F.col("gap"))
    return upto.groupBy("source").agg(F.min(F.struct(F.col(rung).alias("edge"), "gap")).alias("at")).select("source", "at.*")


def drawn(rows: DataFrame) -> DataFrame:
    """rows (source, draw, size, ...; draw tells a row) with source_size, target, copies and taken.

    A document of importance g is wanted rate = min(MOST, c * g) times, c being its source's constant that brings the
    expected words to the target. The whole part of the rate is taken for certain. Of the rest the documents with the
    least ratio of random odds to inclusion odds follow, as long as their words come nearer to what is missing.
    Sizes are gathered by (source, importance), then by (source, slice of the ratio); only documents of the one slice a
    source in which the sum crosses are ordered one by one."""
    rows = rows.withColumn("g", importance(F.col("size")))
    classes = keep(rows.groupBy("source", "g").agg(F.sum("size").alias("words"), F.count("*").alias("many")))
    sizes = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")))
    # c by importance in falling order: the heaviest classes reach MOST first
    sizes = sizes.withColumnRenamed("source", "its")
    per = classes.join(sizes, F.col("source").eqNullSafe(F.col("its"))).select("source", "g", "words", "source_size", "target")
    heavy = Window.partitionBy("source").orderBy(F.col("g").desc())
    full = F.coalesce(F.sum("words").over(heavy.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rest = F.sum(F.col("words") * F.col("g")).over(heavy.rowsBetween(0, Window.unboundedFollowing))
    c = F.when(rest > 0, (F.col("target") - MOST * full) / rest.cast("double")).otherwise(F.lit(0.0))
    per = per.withColumn("c", c)
    fits = F.col("c") * F.col("g") <= MOST
    per = per.withColumn("c", F.coalesce(F.max(F.when(fits, F.col("c"))).over(Window.partitionBy("source")), F.lit(float(MOST))))
    rate = F.least(F.greatest(F.col("c") * F.col("g"), F.lit(0.0)), F.lit(float(MOST)))
    per = keep(per.select(F.col("source").alias("its"), F.col("g").alias("its_g"), "source_size", "target", rate.alias("rate")))
    wanted = rows.join(small(per), F.col("source").eqNullSafe(F.col("its")) & (F.col("g") == F.col("its_g"))).drop("its", "its_g")
    wanted = wanted.withColumn("whole", F.floor("rate").cast("long")).withColumn("part", F.col("rate") - F.floor("rate"))
    # ratio: random odds by inclusion odds; a rate without a fraction is never drawn
    ratio = F.when((F.col("part") > 0) & (F.col("size") > 0), odds(F.col("draw")) * (1 - F.col("part")) / F.col("part"))
    slices = F.floor((F.col("ratio") / (1 + F.col("ratio"))) * (FINE * FINE)).cast("int")
    wanted = keep(wanted.withColumn("ratio", ratio).withColumn("slice", slices))
    sums = keep(wanted.groupBy("source", "slice").agg(F.first("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.sum("size").alias("words")))
    missing = sums.groupBy(F.col("source").alias("s")).agg((F.first("target") - F.sum("certain")).alias("missing"))
    ladder = sums.where("slice is not null").withColumn("coarse", F.floor(F.col("slice") / FINE).cast("int")).select("source", "coarse", "slice", "words")
    rungs = ladder.groupBy("source", "coarse").agg(F.sum("words").alias("words")).join(missing, F.col("source").eqNullSafe(F.col("s")))
    coarse = crossing(rungs, "coarse", F.col("missing")).select(F.col("source").alias("s"), F.col("edge").alias("at"), F.col("gap").alias("left"))
    within = ladder.join(coarse, F.col("source").eqNullSafe(F.col("s")) & (F.col("coarse") == F.col("at")))
    cross = keep(crossing(within, "slice", F.col("left")).withColumnRenamed("source", "its"))
    inside = wanted.join(small(cross), F.col("source").eqNullSafe(F.col("its")) & (F.col("slice") == F.col("edge")))
    one = Window.partitionBy("its").orderBy("ratio", "draw").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("size").over(one)
    nearer = (F.col("upto") <= F.col("gap")) | ((F.col("upto") - F.col("gap")) < (F.col("gap") - (F.col("upto") - F.col("size"))))
    last = inside.withColumn("upto", upto).where(nearer).groupBy("its").agg(F.max(F.struct("ratio", "draw")).alias("last"))
    edges = cross.select("its", "edge").join(last.withColumnRenamed("its", "i"), F.col("its").eqNullSafe(F.col("i")), "left").select("its", "edge", F.col("last.ratio").alias("last_ratio"), F.col("last.draw").alias("last_draw"))
    ready = wanted.join(small(keep(edges)), F.col("source").eqNullSafe(F.col("its")), "left")
    within = F.col("ratio").isNotNull() & (
        F.col("edge").isNull() | (F.col("slice") < F.col("edge"))
        | ((F.col("slice") == F.col("edge")) & F.coalesce(F.struct("ratio", "draw") <= F.struct(F.col("last_ratio").alias("ratio"), F.col("last_draw").alias("draw")), F.lit(False)) & F.col("last_ratio").isNotNull())
    )
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(within, 1).otherwise(0)).otherwise(0).cast("long")
    return ready.withColumn("copies", copies).withColumn("taken", copies * F.col("size")).drop("g", "rate", "whole", "part", "ratio", "slice", "its", "edge", "last_ratio", "last_draw")


def told(docs: DataFrame, key: str, text: str, draw: str) -> DataFrame:
    """docs with `draw`, a string that no other row has: key, hash of the text, and a number where rows repeat both."""
    x = fresh(docs, "own", "n", "turn")
    own = F.concat_ws("|", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))
    named = docs.withColumn(x.own, own)
    twice = keep(named.groupBy(x.own).agg(F.count("*").alias(x.n)).where(F.col(x.n) > 1).select(x.own))
    rows = named.withColumn(x.turn, F.lit(1).cast("long"))
    if not twice.isEmpty():
        rows = named.join(twice, x.own, "left_anti").withColumn(x.turn, F.lit(1).cast("long")).unionByName(numbered(named.join(twice, x.own, "left_semi"), x.own, x.turn))
    return rows.withColumn(draw, F.concat_ws("|", x.own, x.turn)).drop(x.own, x.turn)


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of each row; other columns do not come along.

    Null text has size 0 and is never taken; a null source is a source of its own. Rows may share a key, or have none:
    each row draws for itself, also where rows repeat key and text. Texts of any length are counted whole. Reruns agree on
    all columns. No rows give no rows."""
    rows = told(docs.select(whole_number(docs, key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")), "doc_id", "text", "draw")
    return drawn(keep(rows.select("doc_id", "source", "draw", words(F.col("text")).alias("size")))).drop("draw")


def repeated(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: each row of docs as many times as `mixed` takes it, with all its columns. Of rows that repeat key
    and text but differ otherwise, which one is taken more often is not fixed."""
    x = fresh(docs, "draw", "taken", "copies", "turn")
    rows = told(docs, key, text, x.draw)
    sized = keep(rows.select(F.col(source).cast("string").alias("source"), F.col(x.draw).alias("draw"), words(F.col(text)).alias("size")))
    taken = drawn(sized).where("copies > 0").select(F.col("draw").alias(x.taken), F.col("copies").alias(x.copies))
    met = rows.join(taken, F.col(x.draw) == F.col(x.taken))
    return met.withColumn(x.turn, F.explode(F.sequence(F.lit(1), F.col(x.copies).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return mixed(table(spark, sf_dir, "documents"))
