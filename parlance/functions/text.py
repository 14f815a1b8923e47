"""Scalar functions on text, time, names and model replies, as Spark column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.split and str.strip take it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Marks that end a sentence, and those that count for density.
ENDS = ".!?؟۔"
DENSITY = ".!?؟۔…"
#: Reply codes of sentence types.
MARKS = {"S": ".", "Q": "؟", "E": "!"}
#: What a message of an overflowing request contains.
OVERFLOW = ("context length", "context_length", "context window", "maximum context", "too many tokens", "reduce the length", "exceeds the maximum")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def split_words(text: Column) -> Column:
    """The words between white space; none for blank or null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def ends_sentence(text: Column) -> Column:
    return F.coalesce(text.rlike(rf"[{ENDS}]{SPACE}*\z"), F.lit(False))


def marks(text: Column) -> Column:
    """Number of sentence marks; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[{DENSITY}]")), F.lit(0))


def punctuation_ratio(text: Column) -> Column:
    """Sentence marks a word; 0 for blank text."""
    n = F.size(split_words(text))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.regexp_count(text, F.lit(f"[{DENSITY}]")) / n)


def clock(seconds: Column) -> Column:
    """Seconds rounded half to even as H:MM:SS, after whole days as `N day(s), H:MM:SS`."""
    whole = F.rint(seconds).cast("long")
    days, rest = F.floor(whole / 86400), F.pmod(whole, F.lit(86400))
    time = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    name = F.when(F.abs(days) == 1, " day, ").otherwise(" days, ")
    return F.when(days == 0, time).otherwise(F.concat(days.cast("string"), name, time))


def stamp(seconds: Column) -> Column:
    """Seconds cut to whole ones as HH:MM:SS, hours as wide as they need; negative seconds raise."""
    whole = F.when(seconds < 0, F.raise_error(F.lit("seconds must not be negative")).cast("long")).otherwise(seconds.cast("long"))
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)


def parse_clock(text: Column) -> Column:
    """Seconds of [N day(s), ]H:M:S; null where it is no such text."""
    form = r"\A\s*(?:(-?\d+) days?,)?\s*(\d+(?:\.\d*)?):(\d+(?:\.\d*)?):(\d+(?:\.\d*)?)\s*\z"
    part = lambda k: F.regexp_extract(text, form, k).try_cast("double")
    return F.coalesce(part(1), F.lit(0.0)) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)


def base_language(code: Column) -> Column:
    return F.substring_index(code, "-", 1)


def should_translate(task: Column, source: Column, target: Column) -> Column:
    return (task == "translate") & ~base_language(source).eqNullSafe(base_language(target))


def safe_name(name: Column) -> Column:
    """A file name of letters, digits, dots, dashes and underscores, without `._-` at its ends; `result` if none is left."""
    cut = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), r"\A[._-]+|[._-]+\z", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("result"))


def stem(name: Column) -> Column:
    """A file name without its last extension; a leading dot begins no extension. Empty: `result`."""
    cut = F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("result"))


def download_name(name: Column, artifact: Column) -> Column:
    return F.concat(safe_name(stem(name)), F.lit("_"), artifact)


def quoted(name: Column) -> Column:
    """Percent-encoded, blanks as %20."""
    return F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))


def confidence(value: Column) -> Column:
    low = F.lower(strip(value))
    return F.when(low.isin("high", "medium", "low"), low).otherwise("low")


def overflow_error(message: Column) -> Column:
    low = F.lower(message)
    found = F.lit(False)
    for mark in OVERFLOW:
        found = found | F.contains(low, F.lit(mark))
    return found


def transient_error(kind: Column, status: Column) -> Column:
    return F.coalesce((kind == "connection") | (status == 429) | (status >= 500), F.lit(False))


def boundaries(reply: Column, words: Column) -> Column:
    """array<struct<index, mark>> of a reply's `index:code` pairs, in the order given, those within the words only."""
    form = r"(-?\d+)\s*:\s*([A-Za-z])"
    found = F.arrays_zip(F.regexp_extract_all(reply, F.lit(form), F.lit(1)).alias("i"), F.regexp_extract_all(reply, F.lit(form), F.lit(2)).alias("c"))
    code = F.create_map(*(F.lit(x) for kv in MARKS.items() for x in kv))
    pairs = F.transform(found, lambda p: F.struct(p["i"].try_cast("long").alias("index"), F.coalesce(F.try_element_at(code, F.upper(p["c"])), F.lit(".")).alias("mark")))
    return F.filter(pairs, lambda p: (p["index"] >= 0) & (p["index"] < words))


def first_by_index(pairs: Column) -> Column:
    """Of (index, mark) pairs the first for each index, by index."""
    number = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["index"])))
    return F.transform(number, lambda n: F.struct(n.alias("index"), F.element_at(F.filter(pairs, lambda p: p["index"] == n), 1)["mark"].alias("mark")))


def sentence(text: Column, mark: Column) -> Column:
    return F.when((text != "") & ~ends_sentence(text), F.concat(text, mark)).otherwise(text)


DETECTION = "struct<hate_speech:boolean,category:string,confidence:string,reason:string>"


def detection(raw: Column) -> Column:
    """A moderation reply as a struct: the JSON object, or else the outermost braces in the text, or else the default
    finding. A flag counts as Python counts truth: empty strings, zero, empty lists and null are false."""
    whole = F.try_parse_json(raw)
    inner = F.try_parse_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")))
    v = F.coalesce(whole, inner)
    text = lambda key, other: F.coalesce(F.try_variant_get(v, f"$.{key}", "string"), F.lit(other))
    flag = F.try_variant_get(v, "$.hate_speech", "string")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.hate_speech", "variant"))
    truth = F.when(kind == "BOOLEAN", flag == "true").when(kind == "STRING", flag != "").when(kind == "VOID", F.lit(False))
    truth = truth.when(kind.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), flag.try_cast("double") != 0).otherwise(~flag.isin("[]", "{}"))
    made = F.struct(F.coalesce(truth, F.lit(False)).alias("hate_speech"), F.lower(text("category", "none")).alias("category"), confidence(text("confidence", "low")).alias("confidence"), text("reason", "").alias("reason"))
    default = F.struct(F.lit(False).alias("hate_speech"), F.lit("none").alias("category"), F.lit("low").alias("confidence"), F.lit("Parse error").alias("reason"))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), made).otherwise(default)


def subsample(items: Column, target: Column) -> Column:
    """`target` items evenly spread over an array: item int(i * n / target); all if there are no more, none for 0."""
    n = F.size(items)
    picked = F.transform(F.sequence(F.lit(0), target - 1), lambda i: F.get(items, F.floor(i * (n / target)).cast("int")))
    return F.when(target <= 0, F.slice(items, 1, 0)).when(n <= target, items).otherwise(picked)


def keyframes(minutes: Column, rate: Column, most: Column) -> Column:
    """Number of key frames: minutes by rate, rounded half to even, at least 1 and at most `most`."""
    return F.least(F.greatest(F.rint(minutes * rate), F.lit(1.0)), most.cast("double")).cast("long")


def clamped(rate: Column, most: Column) -> tuple[Column, Column]:
    return F.greatest(rate, F.lit(0.0)), F.least(F.greatest(most, F.lit(0)), F.lit(200))


def pack(text: str | None, budget: int) -> list[str | None]:
    """Chunks of one text, as `packed` gives them, in time that grows with its length."""
    words = (text or "").split()
    if not words:
        return [text]
    done, now, size = [], [], 0
    for w in words:
        for k in range(0, len(w), budget):
            part = w[k : k + budget]
            full = k + budget < len(w)
            if now and (full or size + 1 + len(part) > budget):
                done.append(" ".join(now))
                now, size = [], 0
            if full:
                done.append(part)
            else:
                size += len(part) + bool(now)
                now.append(part)
    return [*done, " ".join(now)] if now else done


def packed(text: Column, budget: int | Column) -> Column:
    """Chunks of at most `budget` characters: words packed greedily, longer words cut; blank text is one chunk as it is."""

    def run(texts: pd.Series, budgets: pd.Series) -> pd.Series:
        return pd.Series([pack(t if isinstance(t, str) else None, int(b)) for t, b in zip(texts, budgets, strict=True)], dtype=object)

    return F.pandas_udf(run, "array<string>")(text, budget if isinstance(budget, Column) else F.lit(budget))


def owner_id(url: Column, stored: Column, fresh: Column) -> Column:
    valid = lambda c: F.when(c.rlike(r"\A[0-9a-f]{32}\z"), c)
    return F.coalesce(valid(url), valid(stored), fresh)


def oversize(name: Column, size: Column, limit_mb: int) -> Column:
    """A message if the size in bytes is above the limit, else null."""
    gib = F.format_string("%.1f", size / float(1 << 30))
    return F.when(size > limit_mb * (1 << 20), F.concat(name, F.lit(" is "), gib, F.lit(f" GB, over the limit of {limit_mb / 1024:.1f} GB")))


def error_key(kind: Column) -> Column:
    return F.when(kind == "ApiError", "common.error_request").when(kind == "TypeError", "common.error_network").otherwise("common.error_unknown")


def service_root(url: Column) -> Column:
    """A service's address without `/v1` and slashes at its end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(url), r"/+\z", ""), r"/v1\z", ""), r"/+\z", "")


def tristate(value: Column) -> Column:
    low = F.lower(strip(value))
    return F.when(low.isin("1", "true", "yes", "on"), F.lit(True)).when(low.isin("0", "false", "no", "off"), F.lit(False))


def filled(template: str, **values: Column) -> Column:
    """A template with {name} places filled from columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


#: Where a sentence ends for entity chunks.
SENTENCE = r"""(?s).+?(?:[.!?]+["')\]]*(?=\s+|$)|\n{2,}|$)"""


def entity_chunks(text: Column, budget: int = 512, whole: bool = False) -> Column:
    """Sentences packed to chunks of at most `budget` words. A sentence that does not fit opens a new chunk and is cut to
    `budget` words; what lies beyond is lost, as in the engine that this follows, or makes further chunks if the text is to be
    kept `whole`. Blank text gives no chunk."""
    found = F.filter(F.transform(F.regexp_extract_all(strip(text), F.lit(SENTENCE), F.lit(0)), strip), lambda s: s != "")
    lists = F.transform(found, split_words)
    if whole:
        parts = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(w) - 1) / budget).cast("int"))), lambda i: F.slice(w, i * budget + 1, budget))
        lists = F.flatten(F.transform(lists, parts))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"))

    def step(s, w):
        over = F.size(s["now"]) + F.size(w) > budget
        flushed = F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(F.array_join(s["now"], " ")))).otherwise(s["done"])
        return F.when(over, F.struct(flushed.alias("done"), F.slice(w, 1, budget).alias("now"))).otherwise(F.struct(s["done"].alias("done"), F.concat(s["now"], w).alias("now")))

    return F.aggregate(lists, start, step, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(F.array_join(s["now"], " ")))).otherwise(s["done"]))


def local_path(name: Column, label: Column, language: Column, extension: str) -> Column:
    """output/<stem>/<stem>_<label>[_<language>].<extension>; a stem keeps its inner dots."""
    s = stem(name)
    return F.concat(F.lit("output/"), s, F.lit("/"), s, F.lit("_"), label, F.coalesce(F.concat(F.lit("_"), language), F.lit("")), F.lit("." + extension))
