"""Queries on names, languages, replies, counts, entities and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import languages as L
from parlance.functions import text as X
from parlance.operators import counts, profiles, scorers
from parlance.plans.oracle import with_tables as ONE
from parlance.sources import derived as D
from parlance.sources import files, folders
from parlance.sources.folders import keep

C = F.col


def docs(spark, sf) -> DataFrame:
    return D.table(spark, sf, "documents").withColumn("file_id", C("doc_id"))


def codes(spark, sf) -> DataFrame:
    """Language codes as they come: plain, with a region, upper case, unknown, empty and missing."""
    kind = C("doc_id") % 6
    code = F.when(kind == 0, C("lang")).when(kind == 1, F.concat("lang", F.lit("-XX"))).when(kind == 2, F.upper("lang")).when(kind == 3, F.lit("qq")).when(kind == 4, F.lit(""))
    return docs(spark, sf).select("doc_id", "lang", code.alias("code"))


CODES = "codes AS (SELECT doc_id, lang, CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN lang || '-XX' WHEN 2 THEN upper(lang) WHEN 3 THEN 'qq' WHEN 4 THEN '' END AS code FROM documents)"


def values_sql(name: str, values: dict[str, str]) -> str:
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in values.items()) + ") v(code, name))"


NAMES, TARGETS = values_sql("names", L.NAMES), values_sql("targets", L.TARGETS)
NAMED = "coalesce((SELECT name FROM names n WHERE n.code = lower(c.code)), (SELECT name FROM names n WHERE n.code = split_part(lower(c.code), '-', 1)))"


def lang_name(spark, sf):
    return L.named(codes(spark, sf), "code", L.dimension(spark, L.NAMES)).select("doc_id", "language")


def export_name(spark, sf):
    return L.export_name(codes(spark, sf), "code", L.dimension(spark, L.NAMES)).select("doc_id", "language")


def target_name(spark, sf):
    return L.target_name(codes(spark, sf), "code", L.dimension(spark, L.TARGETS), L.dimension(spark, L.NAMES)).select("doc_id", "language")


def asr_lang(spark, sf):
    names = L.dimension(spark, L.NAMES)
    said = L.named(codes(spark, sf), "code", names).select("doc_id", F.when(C("doc_id") % 2 == 0, F.lower("language")).otherwise(C("code")).alias("said"))
    return L.recogniser_code(said, "said", names).select("doc_id", "said", "code")


def tokenizer(spark, sf):
    some = codes(spark, sf).withColumn("lang", F.when(C("doc_id") % 5 == 0, "ar").when(C("doc_id") % 7 == 0, "qq").otherwise(C("lang")))
    return L.tokenizer(some, "lang", L.dimension(spark, L.TOKENIZERS)).select("doc_id", "model")


def used(spark, sf, names: dict[str, str]) -> DataFrame:
    """A table of languages with the number of documents in each, those that no document is in among them."""
    n = docs(spark, sf).groupBy(F.lower("lang").alias("code")).agg(F.count("*").alias("documents"))
    return L.dimension(spark, names).join(n, "code", "left").select("code", "name", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"))


USED = "used AS (SELECT code, name, coalesce(n, 0)::BIGINT AS documents FROM {} LEFT JOIN (SELECT lower(lang) AS code, count(*) AS n FROM documents GROUP BY ALL) USING (code))"


def default_targets(spark, sf):
    """The target that is preset for each language that documents are in, were it the configured one."""
    langs = docs(spark, sf).where("lang is not null").select(F.upper("lang").alias("lang"), C("lang").alias("code")).distinct()
    langs = langs.withColumn("code", F.when(C("code") == "fr", "tlh").otherwise(C("code")))
    return L.default_targets(langs, "code", L.TARGETS).select("lang", "target")


def prompts(spark, sf):
    """A prompt in the document's language, else in English; a key that neither has is an error."""
    return prompted(docs(spark, sf).select("doc_id", "lang", F.when(C("doc_id") % 2 == 0, "summary").otherwise("translation").alias("key")))


def prompted(asked: DataFrame) -> DataFrame:
    """(doc_id, prompt) for rows (doc_id, lang, key)."""
    known = asked.sparkSession.createDataFrame([("en", "summary", "Summarise: {text}"), ("en", "translation", "Translate: {text}"), ("de", "summary", "Fasse zusammen: {text}")], "lang string, key string, prompt string")
    own = known.withColumnRenamed("prompt", "own")
    english = known.where("lang = 'en'").select("key", C("prompt").alias("english"))
    missing = F.raise_error(F.concat(F.lit("no prompt for "), C("key"))).cast("string")
    return asked.join(F.broadcast(own), ["lang", "key"], "left").join(F.broadcast(english), "key", "left").select("doc_id", F.coalesce("own", "english", missing).alias("prompt"))


def gate(spark, sf):
    c = codes(spark, sf)
    task = F.when(C("doc_id") % 5 == 0, "transcribe").otherwise("translate")
    return c.select("doc_id", X.should_translate(task, C("code"), F.lit("en-GB")).alias("needed"))


def names(spark, sf) -> DataFrame:
    """File names from addresses of pages, with odd letters, several dots, leading dots and none."""
    last = F.element_at(F.split("url", "/"), -1)
    kind = C("page_id") % 4
    name = F.when(kind == 0, F.concat(last, F.lit(".tar.gz"))).when(kind == 1, F.concat(F.lit("._"), last)).when(kind == 2, F.lit("...")).otherwise(F.concat(F.lit("ä b/"), last, F.lit(".MP3")))
    return D.table(spark, sf, "pages").select("page_id", name.alias("name"))


FILES = r"""files AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN l || '.tar.gz' WHEN 1 THEN '._' || l WHEN 2 THEN '...' ELSE 'ä b/' || l || '.MP3' END AS name
  FROM (SELECT page_id, string_split(url, '/')[-1] AS l FROM pages))"""
STEM = r"coalesce(nullif(CASE WHEN length(name) > 1 AND regexp_matches(name, '^.+\.[^.]*$') THEN regexp_replace(name, '\.[^.]*$', '') ELSE name END, ''), 'result')"
SAFE = r"coalesce(nullif(trim(regexp_replace({}, '[^A-Za-z0-9._-]', '_', 'g'), '._-'), ''), 'result')"


def packed(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(X.packed(C("text"), 200)).alias("pos", "chunk")).withColumn("pos", C("pos").cast("long"))


def parsed_boundaries(spark, sf):
    reply = F.concat((C("doc_id") % 7).cast("string"), F.lit(":S, "), (C("doc_id") % 11).cast("string"), F.lit(":q\n"), (C("doc_id") % 3).cast("string"), F.lit(" : e,-2:S,99:S,4:Z"))
    pairs = X.first_by_index(X.boundaries(reply, F.lit(20)))
    return docs(spark, sf).select("doc_id", F.explode(pairs).alias("p")).select("doc_id", C("p.index").alias("index"), C("p.mark").alias("mark"))


BOUNDARIES = r"""pairs AS (SELECT doc_id, unnest(regexp_extract_all(r, '(-?\d+)\s*:\s*([A-Za-z])', 1))::BIGINT AS i, upper(unnest(regexp_extract_all(r, '(-?\d+)\s*:\s*([A-Za-z])', 2))) AS c,
  generate_subscripts(regexp_extract_all(r, '(-?\d+)\s*:\s*([A-Za-z])', 1), 1) AS ord
  FROM (SELECT doc_id, (doc_id % 7) || ':S, ' || (doc_id % 11) || ':q' || chr(10) || (doc_id % 3) || ' : e,-2:S,99:S,4:Z' AS r FROM documents))"""


def detections(spark, sf) -> DataFrame:
    return D.replies(spark, sf).select("file_id", X.detection(C("raw")).alias("detection"))


DETECTED = """SELECT file_id, CASE WHEN kind IN (2, 3) THEN false ELSE toxic = 1 END AS hate_speech,
  CASE kind WHEN 2 THEN 'none' WHEN 3 THEN 'none' WHEN 1 THEN 'threat' ELSE 'insult' END AS category,
  CASE kind WHEN 0 THEN 'high' WHEN 5 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN kind IN (2, 3) THEN 'Parse error' ELSE 'r' || file_id END AS reason FROM replies JOIN labels ON doc_id = file_id"""


def findings(spark, sf):
    """Findings of replies taken as rows of files of twenty, where a reply of garbage is an outage."""
    rows = D.replies(spark, sf).select(F.floor(C("file_id") / 20).alias("file_id"), (C("file_id") % 20).alias("row_idx"), (C("kind") != 3).alias("ok"), X.detection(C("raw")).alias("detection"))
    return counts.findings(rows).select("file_id", "row_idx", "detection.category", "detection.confidence", "detection.reason")


def moderated(spark, sf):
    """The sweep with the stand-in moderator: the first 2048 characters are sent, the whole text is returned."""
    rows = docs(spark, sf).select("doc_id", "text", X.filled("Check: {text}", text=F.substring("text", 1, 2048)).alias("prompt"))

    def judge(prompts: list[str]) -> list[str | None]:
        return ['{"hate_speech": %s, "category": "Insult", "confidence": "HIGH", "reason": "word list"}' % str("idiot" in p or "scum" in p).lower() for p in prompts]

    found = scorers.scored(rows, "prompt", judge).select("doc_id", "text", X.detection(C("reply")).alias("d"))
    return found.where("d.hate_speech").select("doc_id", F.length("text").alias("characters"), "d.category", "d.confidence")


def word_tokens(spark, sf) -> DataFrame:
    return counts.without_stopwords(counts.tokens(docs(spark, sf)), counts.stopwords(spark))


STOP = "stop AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{w}')" for k, ws in counts.STOPWORDS.items() for w in ws) + ") v(lang, word))"
TOKENS = rf"""{STOP}, tokens AS (SELECT doc_id AS file_id, lang, pos, lower(word) AS word FROM (
  SELECT doc_id, lang, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS word,
    generate_subscripts(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), 1) - 1 AS pos FROM documents)
  WHERE regexp_full_match(word, '\p{{L}}+')),
kept AS (SELECT * FROM tokens t ANTI JOIN stop s ON t.lang = s.lang AND t.word = s.word),
counted AS (SELECT file_id, word, count(*) AS frequency, min(pos) AS first_pos FROM kept GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY frequency DESC, first_pos) AS rank FROM counted) WHERE rank <= 30)"""


def word_counts(spark, sf):
    return counts.word_counts(word_tokens(spark, sf))


def top_words(spark, sf):
    return counts.top_words(word_counts(spark, sf))


def nouns(spark, sf):
    words = word_tokens(spark, sf)
    tagged = words.select("file_id", "word", F.when(F.length("word") % 3 == 0, "NOUN").otherwise("OTHER").alias("pos_tag"))
    return counts.nouns(words, tagged).groupBy("file_id").agg(F.count("*").alias("nouns"))


def entities(spark, sf):
    return counts.entities(D.entity_replies(spark, sf))


def tally(spark, sf):
    return counts.entity_tally(entities(spark, sf))


ENT = "fine AS (SELECT * FROM entity_replies WHERE length(text) >= 3 AND score >= 0.3::DOUBLE)"


def words_pipeline(spark, sf):
    """Per file: how many distinct words, the most frequent ones in order, the words of the cloud, and how many entities."""
    counted = keep(word_counts(spark, sf))
    w = counted.groupBy("file_id").agg(F.count("*").alias("distinct_words"))
    top = counts.cloud_weights(counts.top_words(counted)).groupBy("file_id").agg(D.in_order("word", "rank", ",").alias("top"), F.count_if(C("weight") > 0).alias("cloud"))
    e = tally(spark, sf).groupBy("file_id").agg(F.sum("frequency").alias("entities"))
    return w.join(top, "file_id").join(e, "file_id", "left").withColumn("entities", F.coalesce("entities", F.lit(0).cast("long")))


def cloud_text(spark, sf):
    """What a word cloud is drawn from: each counted word of a file as often as it occurs, in order of first occurrence."""
    some = word_counts(spark, sf).withColumn("repeated", F.array_join(F.array_repeat("word", C("frequency").cast("int")), " "))
    return some.groupBy("file_id").agg(D.in_order("repeated", "first_pos").alias("text"))


def frames(spark, sf):
    n = F.length("text") % 37
    items = F.transform(F.sequence(F.lit(0), n), lambda i: (i * 2).cast("long"))
    return docs(spark, sf).select("doc_id", F.posexplode(X.subsample(items, F.lit(8))).alias("pos", "item")).withColumn("pos", C("pos").cast("long"))


def errors(spark, sf):
    k = C("event_id") % 7
    message = F.when(k == 0, "This model's maximum context is 8k").when(k == 1, "Too MANY tokens here").when(k == 2, "context_length_exceeded").otherwise("bad request")
    status = F.when(k == 3, 429).when(k == 4, 503).when(k == 5, 401)
    kind = F.when(k == 6, "connection").otherwise("status")
    name = F.when(k < 3, "ApiError").when(k < 5, "TypeError").otherwise("Other")
    return D.table(spark, sf, "events").select("event_id", X.overflow_error(message).alias("overflow"), X.transient_error(kind, status).alias("transient"), X.error_key(name).alias("key"))


ERRORS = """SELECT event_id, event_id % 7 < 3 AS overflow, event_id % 7 IN (3, 4, 6) AS transient,
  CASE WHEN event_id % 7 < 3 THEN 'common.error_request' WHEN event_id % 7 < 5 THEN 'common.error_network' ELSE 'common.error_unknown' END AS key FROM events"""


def owners(spark, sf):
    url = F.when(C("event_id") % 3 == 0, F.md5(C("event_id").cast("string"))).when(C("event_id") % 3 == 1, F.upper(F.md5(C("event_id").cast("string"))))
    stored = F.when(C("event_id") % 2 == 0, F.md5(C("user_id").cast("string"))).otherwise("nothing")
    return D.table(spark, sf, "events").select("event_id", X.owner_id(url, stored, F.lit("0" * 32)).alias("owner"))


OWNERS = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN md5(event_id::VARCHAR) WHEN event_id % 2 = 0 THEN md5(user_id::VARCHAR) ELSE repeat('0', 32) END AS owner FROM events"""


#: The bound of an upload's size in the queries.
CAP = 4096


def uploads(spark, sf):
    """Pages as files, each taken or refused by its size alone; only those taken are read and hashed."""
    pages = D.table(spark, sf, "pages").select(F.concat(F.lit("page_"), C("page_id").cast("string"), F.lit(".html")).alias("name"), C("html").alias("content"))
    at = folders.new(spark, "uploads")
    files.write(pages, at, [])
    return files.received(spark, at, CAP).select(F.regexp_extract("name", r"page_(\d+)", 1).cast("long").alias("page_id"), "digest", C("length").alias("size"), "accepted")


UPLOADS = f"SELECT page_id, CASE WHEN strlen(html) <= {CAP} THEN 'sha256:' || sha256(html) END AS digest, strlen(html) AS size, strlen(html) <= {CAP} AS accepted FROM pages"


def hashed(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", F.concat(F.lit("sha256:"), F.sha2(F.encode("html", "utf-8"), 256)).alias("digest"))


def oversize(spark, sf):
    size = C("page_id") * (1 << 27)
    return D.table(spark, sf, "pages").select("page_id", X.oversize(F.lit("f.wav"), size, 8192).alias("message"))


def settings(spark, sf):
    v = F.element_at(F.array(*map(F.lit, ("1", " Yes", "on", "off", "FALSE", "", "maybe"))), (C("event_id") % 7 + 1).cast("int"))
    base = F.element_at(F.array(*map(F.lit, ("http://a:1/v1", "http://a:1/v1/", "http://a:1//", "http://a:1/v2", " "))), (C("event_id") % 5 + 1).cast("int"))
    rate, most = X.clamped(C("event_id") % 9 - 3.0, C("event_id") % 400 - 50)
    return D.table(spark, sf, "events").select("event_id", X.tristate(v).alias("flag"), X.service_root(base).alias("root"), rate.alias("rate"), most.cast("long").alias("most"))


SETTINGS = """SELECT event_id, CASE WHEN event_id % 7 < 3 THEN true WHEN event_id % 7 < 5 THEN false END AS flag,
  CASE event_id % 5 WHEN 3 THEN 'http://a:1/v2' WHEN 4 THEN '' ELSE 'http://a:1' END AS root,
  greatest(event_id % 9 - 3, 0)::DOUBLE AS rate, least(greatest(event_id % 400 - 50, 0), 200)::BIGINT AS most FROM events"""


def capital_pairs(texts: list[str]) -> list[str | None]:
    """Stand-in for an entity model: capitalised words as persons, as JSON; it fails at a word that it cannot read."""
    import json
    import re

    if any(scorers.UNREADABLE in t for t in texts):
        raise ValueError("cannot read this text")
    return [json.dumps([{"text": w, "label": "person", "score": 0.9} for w in re.findall(r"\b[A-Z][a-z]{2,}\b", t, re.ASCII)]) for t in texts]


#: What the stand-in finds in a text.
CAPITALS = r"regexp_extract_all({}, '\b[A-Z][a-z]{{2,}}\b')"


def chunks(spark, sf):
    return docs(spark, sf).select("file_id", F.posexplode(X.entity_chunks(C("text"))).alias("pos", "chunk")).withColumn("pos", C("pos").cast("long"))


def recognised(spark, sf):
    """Entities of each chunk from the stand-in: how many different ones a document has, and how many in all."""
    found = counts.recognised(docs(spark, sf), capital_pairs)
    return counts.entity_tally(counts.entities(found)).groupBy("file_id").agg(F.count("*").alias("entities"), F.sum("frequency").alias("frequency"))


RECOGNISED = f"""SELECT doc_id AS file_id, count(DISTINCT e) AS entities, count(*) AS frequency FROM (SELECT doc_id, unnest({CAPITALS.format("text")}) AS e FROM documents) GROUP BY doc_id"""


def detected(spark, sf):
    """The language of every text, by profiles of four fifths of the documents."""
    profiles_ = keep(profiles.learned(docs(spark, sf).where("doc_id % 5 <> 0")))
    found = profiles.detected(docs(spark, sf).select("file_id", "text"), profiles_)
    return found.withColumn("held_out", C("file_id") % 5 == 0)


def _ranked_sql(key: str, source: str) -> str:
    return f"SELECT * FROM (SELECT {key}, gram, row_number() OVER (PARTITION BY {key} ORDER BY sum(n) DESC, gram) AS r FROM {source} GROUP BY {key}, gram) WHERE r <= 300"


DETECTED_LANG = rf"""WITH w AS (SELECT doc_id, lang, unnest(list_filter(string_split(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g'), ' '), x -> x <> '')) AS word FROM documents),
dw AS (SELECT doc_id, lang, '_' || word || '_' AS word, count(*) AS n FROM w GROUP BY ALL),
g AS (SELECT doc_id, lang, n, unnest(list_concat([substr(word, i, 1) for i in range(2, length(word))], [substr(word, i, 2) for i in range(1, length(word))], [substr(word, i, 3) for i in range(1, length(word) - 1)])) AS gram FROM dw),
train AS (SELECT * FROM g WHERE doc_id % 5 <> 0 AND lang IS NOT NULL), profile AS ({_ranked_sql("lang", "train")}), own AS ({_ranked_sql("doc_id", "g")}),
sized AS (SELECT doc_id, count(*) AS size FROM own GROUP BY doc_id),
far AS (SELECT doc_id, p.lang, (sum(abs(o.r - p.r)) + (any_value(size) - count(*)) * 300)::BIGINT AS distance FROM own o JOIN profile p USING (gram) JOIN sized USING (doc_id) GROUP BY doc_id, p.lang)
SELECT doc_id AS file_id, coalesce(lang, 'en') AS language, distance, doc_id % 5 = 0 AS held_out FROM (SELECT doc_id FROM documents)
LEFT JOIN (SELECT doc_id, min(distance) AS distance, arg_min(lang, (distance, lang)) AS lang FROM far GROUP BY doc_id) USING (doc_id)"""


DOC = lambda column: lambda s, d: docs(s, d).select("doc_id", *column())
FILE = lambda column: lambda s, d: names(s, d).select("page_id", column())
QUERIES = {
    "src_upload": (uploads, UPLOADS),
    "src_hash_cli": (hashed, "SELECT page_id, 'sha256:' || sha256(html) AS digest FROM pages"),
    "src_prompt": (prompts, "SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'Translate: {text}' WHEN lang = 'de' THEN 'Fasse zusammen: {text}' ELSE 'Summarise: {text}' END AS prompt FROM documents"),
    "src_mapping": (lambda s, d: used(s, d, L.NAMES), f"WITH {NAMES}, {USED.format('names')} SELECT * FROM used"),
    "src_nlp_model": (tokenizer, "WITH " + values_sql("models", L.TOKENIZERS) + """ SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'ar_words' ELSE coalesce((SELECT name FROM models m WHERE m.code = CASE WHEN doc_id % 7 = 0 THEN 'qq' ELSE lang END), 'xx_sent_ud_sm') END AS model FROM documents"""),
    "src_llm": (moderated, """SELECT doc_id, length(text)::INT AS characters, 'insult' AS category, 'high' AS confidence FROM documents WHERE contains(left(text, 2048), 'idiot') OR contains(left(text, 2048), 'scum')"""),
    "ml_hate_detect": (moderated, """SELECT doc_id, length(text)::INT AS characters, 'insult' AS category, 'high' AS confidence FROM documents WHERE contains(left(text, 2048), 'idiot') OR contains(left(text, 2048), 'scum')"""),
    "lim_chars": (DOC(lambda: [F.substring("text", 1, 2048).alias("text")]), "SELECT doc_id, left(text, 2048) AS text FROM documents"),
    "join_lang_name": (lang_name, f"WITH {NAMES}, {CODES} SELECT doc_id, coalesce({NAMED}, '') AS language FROM codes c"),
    "join_lang_name_export": (export_name, f"WITH {NAMES}, {CODES} SELECT doc_id, coalesce({NAMED}, CASE WHEN coalesce(code, '') = '' THEN 'German' ELSE code END) AS language FROM codes c"),
    "join_target_name": (target_name, f"WITH {NAMES}, {TARGETS}, {CODES} SELECT doc_id, coalesce((SELECT name FROM targets t WHERE t.code = c.code), {NAMED}, code) AS language FROM codes c"),
    "join_asr_lang": (asr_lang, f"WITH {NAMES}, {CODES}, said AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lower(coalesce({NAMED}, '')) ELSE code END AS said FROM codes c) SELECT doc_id, said, CASE WHEN length(said) <= 3 AND said = lower(said) AND said <> '' THEN said ELSE coalesce((SELECT code FROM names n WHERE lower(n.name) = lower(said)), said) END AS code FROM said"),
    "join_stopwords": (lambda s, d: word_tokens(s, d).groupBy("file_id").agg(F.count("*").alias("words")), f"WITH {TOKENS} SELECT file_id, count(*) AS words FROM kept GROUP BY file_id"),
    "prj_should_translate": (gate, f"WITH {CODES} SELECT doc_id, doc_id % 5 <> 0 AND split_part(code, '-', 1) IS DISTINCT FROM 'en' AS needed FROM codes"),
    "prj_transcript_lang": (lambda s, d: codes(s, d).select("doc_id", F.when(C("doc_id") % 5 == 0, C("code")).otherwise("en").alias("language")), f"WITH {CODES} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN code ELSE 'en' END AS language FROM codes"),
    "fn_base_lang": (lambda s, d: codes(s, d).select("doc_id", X.base_language(C("code")).alias("base")), f"WITH {CODES} SELECT doc_id, split_part(code, '-', 1) AS base FROM codes"),
    "fn_kv_swap": (lambda s, d: used(s, d, L.NAMES).select(C("name").alias("code"), C("code").alias("name"), "documents"), f"WITH {NAMES}, {USED.format('names')} SELECT name AS code, code AS name, documents FROM used"),
    "sort_languages": (lambda s, d: L.by_name(used(s, d, L.NAMES)), f"WITH {NAMES}, {USED.format('names')} SELECT *, row_number() OVER (ORDER BY name) AS pos FROM used"),
    "lang_default_target": (default_targets, f"WITH {TARGETS} SELECT DISTINCT upper(lang) AS lang, coalesce((SELECT code FROM targets t WHERE t.code = d.lang AND d.lang <> 'fr'), 'en') AS target FROM documents d WHERE lang IS NOT NULL"),
    "fn_translation_prompt": (lambda s, d: lang_name(s, d).select("doc_id", X.filled("From {a} to {b}", a=C("language"), b=F.lit("English")).alias("prompt")), f"WITH {NAMES}, {CODES} SELECT doc_id, 'From ' || coalesce({NAMED}, '') || ' to English' AS prompt FROM codes c"),
    "fn_prompts": (DOC(lambda: [X.filled("Sum up: {text}", text=C("text")).alias("prompt")]), "SELECT doc_id, 'Sum up: ' || text AS prompt FROM documents"),
    "fn_sanitize_filename": (FILE(lambda: X.safe_name(C("name")).alias("safe")), f"WITH {FILES} SELECT page_id, {SAFE.format('name')} AS safe FROM files"),
    "fn_file_stem": (FILE(lambda: X.stem(C("name")).alias("stem")), f"WITH {FILES} SELECT page_id, {STEM} AS stem FROM files"),
    "fn_download_name": (FILE(lambda: X.quoted(X.download_name(C("name"), F.lit("summary.txt"))).alias("quoted")), f"WITH {FILES} SELECT page_id, url_encode({SAFE.format(STEM)} || '_summary.txt') AS quoted FROM files"),
    "fn_split_budget": (packed, r"""SELECT doc_id, pos - 1 AS pos, chunk FROM (SELECT doc_id, unnest(l) AS chunk, generate_subscripts(l, 1) AS pos FROM (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [text] ELSE list_reduce(list_transform(w, lambda x: [x]), lambda a, b: CASE WHEN length(a[-1]) + 1 + length(b[1]) <= 200 THEN list_append(a[:-2], a[-1] || ' ' || b[1]) ELSE list_concat(a, b) END) END AS l
      FROM (SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents)))"""),
    "fn_parse_boundaries": (parsed_boundaries, f"WITH {BOUNDARIES} SELECT doc_id, i AS index, arg_min(CASE c WHEN 'S' THEN '.' WHEN 'Q' THEN '؟' WHEN 'E' THEN '!' ELSE '.' END, ord) AS mark FROM pairs WHERE i BETWEEN 0 AND 19 GROUP BY ALL"),
    "fn_parse_detection": (lambda s, d: detections(s, d).select("file_id", "detection.*"), ONE(DETECTED, "replies")),
    "fn_default_detection": (lambda s, d: detections(s, d).where("detection.reason = 'Parse error'").select("file_id", "detection.*"), ONE(f"SELECT * FROM ({DETECTED}) WHERE reason = 'Parse error'", "replies")),
    "fn_norm_confidence": (lambda s, d: D.replies(s, d).select("file_id", X.confidence(F.when(C("kind") == 0, " High ").when(C("kind") == 1, "medium").when(C("kind") == 2, "sure")).alias("confidence")), ONE("SELECT file_id, CASE kind WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM replies", "replies")),
    "flt_flagged": (lambda s, d: detections(s, d).where("detection.hate_speech").select("file_id", "detection.category"), ONE(f"SELECT file_id, category FROM ({DETECTED}) WHERE hate_speech", "replies")),
    "agg_flag_summary": (lambda s, d: detections(s, d).agg(F.count_if(C("detection.hate_speech")).alias("flagged"), F.count("*").alias("total")), ONE(f"SELECT count_if(hate_speech)::BIGINT AS flagged, count(*) AS total FROM ({DETECTED})", "replies")),
    "ml_hate_sweep": (findings, ONE(f"""SELECT file_id // 20 AS file_id, file_id % 20 AS row_idx, category, confidence, reason FROM (
      SELECT *, min(CASE WHEN kind = 3 THEN file_id END) OVER (PARTITION BY file_id // 20) AS stop FROM ({DETECTED}) JOIN (SELECT file_id, kind FROM replies) USING (file_id))
      WHERE hate_speech AND (stop IS NULL OR file_id < stop)""", "replies")),
    "pipe_hate": (findings, ONE(f"""SELECT file_id // 20 AS file_id, file_id % 20 AS row_idx, category, confidence, reason FROM (
      SELECT *, min(CASE WHEN kind = 3 THEN file_id END) OVER (PARTITION BY file_id // 20) AS stop FROM ({DETECTED}) JOIN (SELECT file_id, kind FROM replies) USING (file_id))
      WHERE hate_speech AND (stop IS NULL OR file_id < stop)""", "replies")),
    "flt_word": (lambda s, d: counts.tokens(docs(s, d)).groupBy("file_id").agg(F.count("*").alias("words")), f"WITH {TOKENS} SELECT file_id, count(*) AS words FROM tokens GROUP BY file_id"),
    "flt_noun": (nouns, f"WITH {TOKENS} SELECT file_id, count(*) AS nouns FROM kept WHERE length(word) % 3 = 0 GROUP BY file_id"),
    "agg_word_count": (word_counts, f"WITH {TOKENS} SELECT * FROM counted"),
    "top_words": (top_words, f"WITH {TOKENS} SELECT * FROM top"),
    "snk_png_cloud": (lambda s, d: counts.cloud_weights(top_words(s, d)).select("file_id", "word", "weight"), f"WITH {TOKENS} SELECT file_id, word, frequency / max(frequency) OVER (PARTITION BY file_id) AS weight FROM top"),
    "fn_wordcloud_text": (cloud_text, f"WITH {TOKENS} SELECT file_id, string_agg(rtrim(repeat(word || ' ', frequency)), ' ' ORDER BY first_pos) AS text FROM counted GROUP BY file_id"),
    "flt_entity": (entities, ONE("SELECT * FROM entity_replies WHERE length(text) >= 3 AND score >= 0.3::DOUBLE", "entity_replies")),
    "agg_entity_tally": (tally, ONE("", "entity_replies").rstrip() + f", {ENT} SELECT * EXCLUDE (f), row_number() OVER (PARTITION BY file_id ORDER BY f, category) AS rank FROM (SELECT file_id, upper(label) AS category, text AS entity, count(*) AS frequency, min(pos) AS f FROM fine GROUP BY ALL)"),
    "pipe_words": (words_pipeline, ONE("", "entity_replies").rstrip() + f", {ENT}, {TOKENS} SELECT file_id, distinct_words, top, cloud, coalesce(entities, 0)::BIGINT AS entities FROM (SELECT file_id, count(*) AS distinct_words FROM counted GROUP BY file_id) JOIN (SELECT file_id, string_agg(word, ',' ORDER BY rank) AS top, count(*) AS cloud FROM top GROUP BY file_id) USING (file_id) LEFT JOIN (SELECT file_id, count(*) AS entities FROM fine GROUP BY file_id) USING (file_id)"),
    "src_keyframes": (frames, """SELECT doc_id, pos - 1 AS pos, item FROM (SELECT doc_id, unnest(l) AS item, generate_subscripts(l, 1) AS pos FROM (
      SELECT doc_id, CASE WHEN n <= 8 THEN [i * 2 for i in range(n)] ELSE [floor(i * (n / 8.0::DOUBLE))::BIGINT * 2 for i in range(8)] END AS l FROM (SELECT doc_id, length(text) % 37 + 1 AS n FROM documents)))"""),
    "fn_ner_chunks": (chunks, None),
    "src_ner": (recognised, RECOGNISED),
    "ml_detect_lang": (detected, DETECTED_LANG.replace("x -> x", "lambda x: x")),
    "keyframe_target": (DOC(lambda: [X.keyframes(F.length("text") / 100.0, F.lit(0.5), F.lit(20)).alias("frames")]), "SELECT doc_id, least(greatest(round_even(length(text) / 100.0::DOUBLE * 0.5::DOUBLE, 0), 1), 20)::BIGINT AS frames FROM documents"),
    "keyframe_clamp": (lambda s, d: settings(s, d).select("event_id", "rate", "most"), f"SELECT event_id, rate, most FROM ({SETTINGS})"),
    "fn_tristate": (lambda s, d: settings(s, d).select("event_id", "flag"), f"SELECT event_id, flag FROM ({SETTINGS})"),
    "fn_service_root": (lambda s, d: settings(s, d).select("event_id", "root"), f"SELECT event_id, root FROM ({SETTINGS})"),
    "fn_context_error": (lambda s, d: errors(s, d).select("event_id", "overflow"), f"SELECT event_id, overflow FROM ({ERRORS})"),
    "fn_transient_error": (lambda s, d: errors(s, d).select("event_id", "transient"), f"SELECT event_id, transient FROM ({ERRORS})"),
    "fn_error_descriptor": (lambda s, d: errors(s, d).select("event_id", "key"), f"SELECT event_id, key FROM ({ERRORS})"),
    "fn_owner_id": (owners, OWNERS),
    "fn_optional_str": (lambda s, d: D.table(s, d, "events").select("event_id", F.when(C("event_id") % 3 == 0, C("user_id")).cast("string").alias("text")), "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id::VARCHAR END AS text FROM events"),
    "fn_oversize_message": (oversize, "SELECT page_id, CASE WHEN page_id * 134217728 > 8589934592 THEN 'f.wav is ' || printf('%.1f', floor(page_id / 8.0::DOUBLE * 10 + 0.5::DOUBLE) / 10::DOUBLE) || ' GB, over the limit of 8.0 GB' END AS message FROM pages"),
}
