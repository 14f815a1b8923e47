"""Queries on exports, archives, job lists and event streams."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as X
from parlance.operators import counts, scorers, sentences
from parlance.operators import exports as E
from parlance.operators import jobs as J
from parlance.operators.slots import Slots
from parlance.plans import speech, texts
from parlance.plans.oracle import summary_tables
from parlance.plans.oracle import with_tables as ONE
from parlance.plans.speech import timed, with_timed
from parlance.sources import derived as D
from parlance.sources import files, folders
from parlance.streaming import events as S
from parlance.streaming import subscriptions as U

C = F.col


# exports


def blocks(spark, sf) -> DataFrame:
    return E.text_blocks(timed(spark, sf))


HEAD = "repeat('=', 40) || chr(10) || '[' || start || ' - ' || \"end\" || ']' || CASE WHEN speaker IS NOT NULL THEN '  ' || speaker ELSE '' END || chr(10) || repeat('=', 40) || chr(10)"
BLOCKS = f"SELECT file_id, string_agg({HEAD} || {{}}, chr(10) || chr(10) ORDER BY row_idx) || chr(10) AS content FROM timed {{}} GROUP BY file_id"


def record_rows(spark, sf) -> DataFrame:
    return record_rows_of(timed(spark, sf))


def records_of(transcript: DataFrame) -> DataFrame:
    return E.records(record_rows_of(transcript))


def record_rows_of(transcript: DataFrame) -> DataFrame:
    """Rows with what a record needs; every ninth time cannot be read."""
    t = transcript.withColumn("start", F.when(C("row_idx") % 9 == 4, F.lit("soon")).otherwise(C("start")))
    rows = E.record_rows(t)
    return rows.withColumn("file_name", F.concat(F.lit('a"'), C("file_id").cast("string"), F.lit(".wav"))).withColumn(
        "file_hash", F.when(C("file_id") % 3 == 0, F.concat(F.lit("sha256:"), F.sha2(C("file_id").cast("string"), 256)))
    ).withColumn("language", F.when(C("file_id") % 5 != 0, X.base_language(F.lit("de-DE"))))


def job_lines(spark, sf) -> DataFrame:
    """One payload a job: its name and lines, in the base language of the source, whatever it was translated to."""
    return E.lines_file(records(spark, sf)).select(C("file_id").alias("job_id"), F.concat(C("file_id").cast("string"), F.lit("_segments.jsonl")).alias("name"), "content")


def batch_lines(spark, sf) -> DataFrame:
    """The payloads of an owner's jobs one after the other: lines with their place. Ten recordings are one owner's."""
    own = records(spark, sf).withColumn("owner_id", F.floor(C("file_id") / 10))
    place = F.row_number().over(Window.partitionBy("owner_id").orderBy("file_id", "sentence_index"))
    return own.select("owner_id", place.cast("long").alias("place"), "line")


REC = r"""rec AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_idx) - 1 AS sentence_index, round_even(start_s0, 0)::DOUBLE AS s, round_even(end_s0, 0)::DOUBLE AS e
  FROM (SELECT t.*, x.start_s AS start_s0, x.end_s AS end_s0 FROM timed t JOIN transcript x USING (file_id, row_idx)) WHERE row_idx % 9 <> 4),
stamped AS (SELECT *, lpad((s::BIGINT // 3600)::VARCHAR, 2, '0') || ':' || lpad((s::BIGINT % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s::BIGINT % 60)::VARCHAR, 2, '0') AS st,
  lpad((e::BIGINT // 3600)::VARCHAR, 2, '0') || ':' || lpad((e::BIGINT % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((e::BIGINT % 60)::VARCHAR, 2, '0') AS et FROM rec),
lines AS (SELECT file_id, sentence_index, '{"source_file": "a\"' || file_id || '.wav", ' || CASE WHEN file_id % 3 = 0 THEN '"source_file_hash": "sha256:' || sha256(file_id::VARCHAR) || '", ' ELSE '' END ||
  '"language": ' || CASE WHEN file_id % 5 <> 0 THEN '"de"' ELSE 'null' END || ', "sentence_index": ' || sentence_index || ', "start_seconds": ' || s || ', "end_seconds": ' || e ||
  ', "start_ts": "' || st || '", "end_ts": "' || et || '", ' || CASE WHEN speaker IS NOT NULL THEN '"speaker": "' || speaker || '", ' ELSE '' END || '"text": "' || text || '"}' AS line FROM stamped)"""


def with_lines(sql: str) -> str:
    return with_timed("").rstrip() + f",\n{REC}\n" + sql


def records(spark, sf) -> DataFrame:
    return records_of(timed(spark, sf))


def results(spark, sf) -> DataFrame:
    """Jobs with flags of what they produced."""
    j = D.jobs(spark, sf).withColumn("stem", X.stem(C("file_name")))
    flag = lambda n, k: (C("job_id") % n == k)
    return j.select(
        "owner_id", "job_id", "created_at", "file_name", "stem", (~flag(5, 0)).alias("has_transcript"), flag(4, 1).alias("has_translation"), flag(3, 1).alias("has_summary"),
        flag(2, 1).alias("has_words"), flag(6, 2).alias("has_entities"), flag(7, 3).alias("has_cloud"), flag(8, 4).alias("has_findings"),
        F.when(flag(10, 1), C("job_id") % 4).otherwise(F.lit(0)).alias("n_frames"),
        F.when(flag(3, 1), F.concat(F.lit("  Sum of "), C("job_id").cast("string"), F.lit(" \n"))).when(flag(3, 2), "  ").alias("summary"),
    )


MEMBERS = """results AS (SELECT *, replace(file_name, '.wav', '') AS stem FROM jobs),
members AS (SELECT owner_id, job_id, stem, created_at, unnest(l) AS member, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT owner_id, job_id, stem, created_at, list_concat(
  CASE WHEN job_id % 5 <> 0 THEN [stem || '_transcript.csv', stem || '_transcript.xlsx', stem || '_transcript.txt'] ELSE [] END,
  CASE WHEN job_id % 4 = 1 THEN [stem || '_translation.txt'] ELSE [] END, CASE WHEN job_id % 3 = 1 THEN [stem || '_summary.txt'] ELSE [] END,
  CASE WHEN job_id % 2 = 1 THEN [stem || '_words.csv', stem || '_words.xlsx'] ELSE [] END, CASE WHEN job_id % 6 = 2 THEN [stem || '_entities.csv', stem || '_entities.xlsx'] ELSE [] END,
  CASE WHEN job_id % 7 = 3 THEN [stem || '_wordcloud.png'] ELSE [] END, CASE WHEN job_id % 8 = 4 THEN [stem || '_hate_speech.csv', stem || '_hate_speech.xlsx'] ELSE [] END,
  CASE WHEN job_id % 5 <> 0 THEN [stem || '_segments.jsonl'] ELSE [] END,
  CASE WHEN job_id % 10 = 1 THEN list_transform(range(job_id % 4), lambda i: 'keyframes/frame_00' || i || '.jpg') ELSE [] END) AS l FROM results)),
placed AS (SELECT *, CASE WHEN n = 1 THEN stem ELSE stem || '_' || n END AS folder FROM (SELECT owner_id, job_id, stem, row_number() OVER (PARTITION BY owner_id, stem ORDER BY created_at, job_id) AS n FROM results
  SEMI JOIN (SELECT DISTINCT job_id FROM members) m USING (job_id)))"""


def with_members(sql: str) -> str:
    return ONE("", "jobs").rstrip() + f",\n{MEMBERS}\n" + sql


SHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
ARTIFACTS = f"""SELECT job_id, a.name AS artifact, a.kind AS media_type FROM (SELECT job_id, unnest(list_concat(
  CASE WHEN job_id % 5 <> 0 THEN [{{'name': 'transcript.csv', 'kind': 'text/csv'}}, {{'name': 'transcript.xlsx', 'kind': '{SHEET}'}}, {{'name': 'transcript.txt', 'kind': 'text/plain'}}, {{'name': 'segments.jsonl', 'kind': 'application/x-ndjson'}}] ELSE [] END,
  CASE WHEN job_id % 4 = 1 THEN [{{'name': 'translation.txt', 'kind': 'text/plain'}}] ELSE [] END, CASE WHEN job_id % 3 = 1 THEN [{{'name': 'summary.txt', 'kind': 'text/plain'}}] ELSE [] END,
  CASE WHEN job_id % 2 = 1 THEN [{{'name': 'wordcounts.csv', 'kind': 'text/csv'}}, {{'name': 'wordcounts.xlsx', 'kind': '{SHEET}'}}] ELSE [] END,
  CASE WHEN job_id % 6 = 2 THEN [{{'name': 'entities.csv', 'kind': 'text/csv'}}, {{'name': 'entities.xlsx', 'kind': '{SHEET}'}}] ELSE [] END,
  CASE WHEN job_id % 7 = 3 THEN [{{'name': 'wordcloud.png', 'kind': 'image/png'}}] ELSE [] END,
  CASE WHEN job_id % 8 = 4 THEN [{{'name': 'hate_speech.csv', 'kind': 'text/csv'}}, {{'name': 'hate_speech.xlsx', 'kind': '{SHEET}'}}] ELSE [] END,
  CASE WHEN job_id % 10 = 1 AND job_id % 4 > 0 THEN [{{'name': 'keyframes.zip', 'kind': 'application/zip'}}] ELSE [] END,
  CASE WHEN job_id % 5 <> 0 OR job_id % 4 = 1 OR job_id % 3 = 1 OR job_id % 2 = 1 OR job_id % 6 = 2 OR job_id % 7 = 3 OR job_id % 8 = 4 THEN [{{'name': 'archive.zip', 'kind': 'application/zip'}}] ELSE [] END)) AS a FROM jobs)"""


def members(spark, sf) -> DataFrame:
    return E.members(results(spark, sf))


def placed(spark, sf) -> DataFrame:
    """Folders of jobs that have members; jobs that gave nothing take no folder."""
    some = members(spark, sf).select("job_id").distinct()
    return J.folders(results(spark, sf).join(some, "job_id", "left_semi"), ["owner_id"], ["created_at", "job_id"])


def batch(spark, sf) -> DataFrame:
    """(owner_id, name): each owner's archive, the manifest of summaries first where there is one."""
    own = members(spark, sf).join(placed(spark, sf).select("job_id", "folder"), "job_id").select("owner_id", F.concat("folder", F.lit("/"), "member").alias("name"))
    return own.unionByName(manifest(spark, sf).select("owner_id", F.lit("batch_summaries.txt").alias("name")))


def manifest(spark, sf) -> DataFrame:
    return E.manifest(results(spark, sf), "owner_id", ["created_at", "job_id"])


def stage_figures(spark, sf) -> DataFrame:
    """What the five stages of all jobs made, each figure gathered while its stage's table was written: one scan a stage."""
    loud = timed(spark, sf).where("file_id % 7 <> 0")
    t, first = J.observed(loud, rows=F.count("*"), characters=F.sum(F.length("text")))
    shown, second = J.observed(t.withColumn("text", sentences.effective()), translated=F.count_if("has_translation"))
    whole = sentences.file_text(shown, "row_idx")
    words, third = J.observed(counts.word_counts(counts.without_stopwords(counts.tokens(whole.withColumn("lang", F.lit("en"))), counts.stopwords(spark))), words=F.count("*"), occurrences=F.sum("frequency"))
    entities, found = J.observed(counts.entity_tally(counts.entities(counts.recognised(whole, texts.capital_pairs))), entities=F.count("*"))
    sums, fourth = J.observed(scorers.summarised(whole.where("file_id % 3 = 0"), 600), summaries=F.count_if(C("summary") != ""))
    flags, fifth = J.observed(shown.where(F.length("text") % 11 == 0), flagged=F.count("*"))
    each = [first, second, third | found, fourth, fifth]
    rows = [(i, J.STAGES[i], k, v) for i, figures in enumerate(each) for k, v in figures.items()]
    return spark.createDataFrame(rows, "stage_index long, stage string, figure string, value long")


STAGE_FIGURES = "SELECT i AS stage_index, s AS stage, k AS figure, v::BIGINT AS value FROM (" + " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS i, '{J.STAGES[i]}' AS s, '{k}' AS k, (SELECT coalesce({v}, 0)) AS v"
    for i, k, v in [
        (0, "rows", "(SELECT count(*) FROM loud)"), (0, "characters", "(SELECT sum(length(text)) FROM loud)"), (1, "translated", "(SELECT count_if(has_translation) FROM loud)"),
        (2, "words", "(SELECT count(*) FROM counted)"), (2, "occurrences", "(SELECT sum(frequency) FROM counted)"), (2, "entities", "(SELECT count(*) FROM found)"),
        (3, "summaries", "(SELECT count_if(summary <> '') FROM summaries)"), (4, "flagged", "(SELECT count(*) FROM flagged)"),
    ]
) + ")"


class Produced:
    """What the jobs of all files gave, each table kept: the transcript (rows of silent files, every seventh, are none), words,
    entities and findings of the text in its last language, summaries of every third file, and record lines."""

    def __init__(self, spark, sf):
        loud = C("file_id") % 7 != 0
        self.transcript = folders.keep(timed(spark, sf).where(loud))
        shown = self.transcript.withColumn("text", sentences.effective())
        texts_ = folders.keep(sentences.file_text(shown, "row_idx"))
        some = texts_.withColumn("lang", F.lit("en"))
        self.words = counts.top_words(counts.word_counts(counts.without_stopwords(counts.tokens(some), counts.stopwords(spark))))
        self.words = folders.keep(self.words)
        self.entities = folders.keep(counts.entity_tally(counts.entities(counts.recognised(texts_, texts.capital_pairs))))
        flagged = shown.where(F.length("text") % 11 == 0)
        said = {"category": "insult", "confidence": "high", "reason": "length"}
        self.findings = flagged.select("file_id", "row_idx", "text", "start", *(F.lit(v).alias(k) for k, v in said.items()))
        self.summaries = folders.keep(scorers.summarised(texts_.where("file_id % 3 = 0"), 600))
        self.lines = records_of(self.transcript)


    def rendered(self) -> DataFrame:
        return E.rendered(self.transcript, self.words, self.entities, self.findings, self.summaries, self.lines)


def cell_sql(column: str) -> str:
    return f"CASE WHEN regexp_matches({column}, '[,\"\\r\\n]') THEN '\"' || replace({column}, '\"', '\"\"') || '\"' ELSE coalesce({column}, '') END"


_UNSEEN = r"CASE WHEN contains(text, '(unreadable)') THEN array_to_string(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')[513:], ' ') ELSE text END"
_KEYS = "file_id, row_idx, start, text"
PRODUCED = (
    f"""loud AS (SELECT * FROM timed WHERE file_id % 7 <> 0),
said AS (SELECT file_id, row_idx, start, coalesce(translation, text) AS text FROM loud),
jobtexts AS (SELECT file_id AS doc_id, 'en' AS lang, string_agg(text, ' ' ORDER BY row_idx) AS text FROM said GROUP BY file_id),
asked_for AS (SELECT doc_id AS file_id, text FROM jobtexts WHERE doc_id % 3 = 0),
{summary_tables("asked_for", 600)},
{texts.TOKENS.replace("FROM documents", "FROM jobtexts")},
found AS (SELECT file_id, 'PERSON' AS category, entity, count(*) AS frequency, row_number() OVER (PARTITION BY file_id ORDER BY min(i)) AS rank FROM (
  SELECT doc_id AS file_id, unnest(l) AS entity, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {texts.CAPITALS.format("(" + _UNSEEN + ")")} AS l FROM jobtexts)) GROUP BY file_id, entity),
flagged AS (SELECT *, 'insult' AS category, 'high' AS confidence, 'length' AS reason FROM said WHERE length(text) % 11 = 0)"""
)


def csv_sql(name: str, rows: str, order: str, head: str, line: str) -> str:
    return f"SELECT file_id, '{name}' AS artifact, max({head}) || chr(10) || string_agg({line}, chr(10) ORDER BY {order}) || chr(10) AS shown FROM {rows} GROUP BY file_id"


def cells_sql(name: str, rows: str, order: str, head: str, line: str) -> str:
    return f"SELECT file_id, '{name}' AS artifact, max({head}) || ' ' || string_agg({line}, ' ' ORDER BY {order}) AS shown FROM {rows} GROUP BY file_id"


_ROW = [("start", None), ('"end"', None), ("speaker", "has_speaker"), ("text", None), ("translation", "has_translation")]


def _optional(value, between: str) -> str:
    each = [f"'{between}' || {value(c)}" if there is None else f"CASE WHEN {there} THEN '{between}' || {value(c)} ELSE '' END" for c, there in _ROW]
    return "substr(" + " || ".join(each) + f", {len(between) + 1})"


_WORD, _ENTITY, _FINDING = ("word", "frequency"), ("entity", "category", "frequency"), ("hate_speech", "category", "confidence", "reason", "text", "start")
_joined = lambda columns, between, value=lambda c: f"({c})::VARCHAR": f" || '{between}' || ".join("'True'" if c == "hate_speech" else value(c) for c in columns)
_csv = lambda columns: _joined(columns, ",", lambda c: cell_sql(f"({c})::VARCHAR"))
SINGLE = " UNION ALL ".join([
    csv_sql("transcript.csv", "loud", "row_idx", _optional(lambda c: "'" + c.strip('"') + "'", ","), _optional(cell_sql, ",")),
    cells_sql("transcript.xlsx", "loud", "row_idx", _optional(lambda c: "'" + c.strip('"') + "'", " "), _optional(lambda c: c, " ")),
    "SELECT file_id, 'transcript.txt', content FROM (" + BLOCKS.format("text", "").replace("FROM timed", "FROM loud") + ")",
    "SELECT file_id, 'translation.txt', content FROM (" + BLOCKS.format("translation", "WHERE has_translation").replace("FROM timed", "FROM loud") + ")",
    "SELECT file_id, 'summary.txt', summary FROM summaries",
    csv_sql("wordcounts.csv", "top", "rank", "'word,frequency'", _csv(_WORD)), cells_sql("wordcounts.xlsx", "top", "rank", "'word frequency'", _joined(_WORD, " ")),
    csv_sql("entities.csv", "found", "rank", "'entity,category,frequency'", _csv(_ENTITY)), cells_sql("entities.xlsx", "found", "rank", "'entity category frequency'", _joined(_ENTITY, " ")),
    csv_sql("hate_speech.csv", "flagged", "row_idx", "'" + ",".join(_FINDING) + "'", _csv(_FINDING)), cells_sql("hate_speech.xlsx", "flagged", "row_idx", "'" + " ".join(_FINDING) + "'", _joined(_FINDING, " ")),
    "SELECT file_id, 'segments.jsonl', string_agg(line, chr(10) ORDER BY sentence_index) || chr(10) FROM lines WHERE file_id % 7 <> 0 GROUP BY file_id",
])
ORDER = "(VALUES " + ", ".join(f"('{name}', '{end}', {i})" for i, (name, end) in enumerate(E.MEMBERS.items())) + ") o(artifact, ending, place)"
KIND = "CASE " + " ".join(f"WHEN artifact = '{k}' THEN '{v}'" for k, v in E.ARTIFACTS.items()) + " END"
#: A member of an archive as it is compared: a workbook by its name, any other also by its hash.
_MEMBER = "{name} || CASE WHEN {name} LIKE '%.xlsx' THEN '' ELSE ' ' || sha256({content}) END"


def with_produced(sql: str) -> str:
    return with_lines("").rstrip() + f",\n{PRODUCED},\nsingle AS ({SINGLE})\n" + sql


ARTIFACT_BYTES = f"""SELECT file_id, artifact, {KIND} AS media_type, shown FROM (SELECT file_id, artifact, shown FROM single UNION ALL
  SELECT file_id, 'archive.zip', string_agg({_MEMBER.format(name="(file_id || ending)", content="shown")}, chr(10) ORDER BY place) FROM single JOIN {ORDER} USING (artifact) GROUP BY file_id)"""
BATCH_BYTES = f"""SELECT file_id // 10 AS owner_id, 'segments.jsonl' AS artifact, string_agg(line || chr(10), '' ORDER BY file_id, sentence_index) AS shown FROM lines WHERE file_id % 7 <> 0 GROUP BY ALL
UNION ALL SELECT owner_id, 'archive.zip', string_agg(shown, chr(10) ORDER BY job, place) FROM (
  SELECT file_id // 10 AS owner_id, file_id AS job, place, {_MEMBER.format(name="(file_id || '/' || file_id || ending)", content="shown")} AS shown FROM single JOIN {ORDER} USING (artifact)
  UNION ALL SELECT file_id // 10, -1, 0, {_MEMBER.format(name="'batch_summaries.txt'", content="string_agg(repeat('=', 40) || chr(10) || file_id || '.wav' || chr(10) || repeat('=', 40) || chr(10) || chr(10) || summary || chr(10), chr(10) ORDER BY file_id)")} FROM summaries GROUP BY ALL) GROUP BY owner_id"""


def shown_members(zips: DataFrame, *keys: str) -> DataFrame:
    """(keys, shown): what archives hold: names of workbooks, names and hashes of all else, in order."""
    each = E.unpacked(zips.withColumnRenamed("content", "archive"), *keys)
    line = F.concat("member", F.when(C("member").endswith(".xlsx"), "").otherwise(F.concat(F.lit(" "), F.sha2("content", 256))))
    return each.withColumn("line", line).groupBy(*keys).agg(D.in_order("line", "pos", "\n").alias("shown"))


BOOKS, ZIPS = (".xlsx",), (".zip",)


def shown_files(found, key: str) -> DataFrame:
    """(key, artifact, shown) of files read again: the text, or a workbook's cells, or members. `found` gives (key, artifact,
    content) of the files whose names have some ends and not others, so that each file is read once."""
    keys = [key, "artifact"]
    text = found(but=BOOKS + ZIPS).select(*keys, F.decode("content", "utf-8").alias("shown"))
    sheet = E.unpacked(found(only=BOOKS).withColumnRenamed("content", "archive"), *keys).where("member = 'xl/worksheets/sheet1.xml'")
    cells = F.regexp_extract_all(F.decode("content", "utf-8"), F.lit("<(?:t xml:space=\"preserve\"|v)>([^<]*)<"), F.lit(1))
    return text.unionByName(sheet.select(*keys, F.array_join(cells, " ").alias("shown"))).unionByName(shown_members(found(only=ZIPS), *keys))


def reread(spark, at: str, key: str, only: tuple = (), but: tuple = ()) -> DataFrame:
    """(key, artifact, content) of files <key>/<artifact> under a path."""
    found = files.contents(spark, at, only, but)
    return found.select(F.substring_index("name", "/", 1).cast("long").alias(key), F.substring_index("name", "/", -1).alias("artifact"), "content")


def artifact_files(spark, sf) -> DataFrame:
    """Every artifact of every job, written as a file <job>/<artifact>, read again and compared by what it holds."""
    made = folders.keep(Produced(spark, sf).rendered())
    single = made.select(F.concat_ws("/", "file_id", "artifact").alias("name"), F.lit(None).cast("string").alias("member"), F.lit(0).alias("place"), "content")
    zips = E.archive_rows(made, C("file_id").cast("string")).select(F.concat(C("file_id").cast("string"), F.lit("/archive.zip")).alias("name"), "member", "place", "content")
    at = folders.new(spark, "artifacts")
    files.write(single.unionByName(zips), at, ["place"])
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in E.ARTIFACTS.items() for x in kv)), C("artifact"))
    return shown_files(partial(reread, spark, at, "file_id"), "file_id").withColumn("media_type", kind)


def batch_artifact_files(spark, sf) -> DataFrame:
    """An owner's two artifacts over all its jobs, ten an owner. An owner's lines and members are never one value: they are
    rows, in order, that the task which writes the file sees one by one."""
    produced = Produced(spark, sf)
    owner = F.floor(C("file_id") / 10).cast("string")
    name = lambda artifact: F.concat(owner, F.lit("/" + artifact)).alias("name")
    none = F.lit(None).cast("string").alias("member")
    lines = produced.lines.select(name("segments.jsonl"), none, C("file_id").alias("job"), C("sentence_index").alias("place"), F.encode(F.concat("line", F.lit("\n")), "utf-8").alias("content"))
    members_ = E.archive_rows(produced.rendered(), F.concat_ws("/", "file_id", "file_id"))
    members_ = members_.select(name("archive.zip"), "member", C("file_id").alias("job"), "place", "content")
    sums = produced.summaries.withColumn("owner_id", F.floor(C("file_id") / 10)).withColumn("file_name", F.concat(C("file_id").cast("string"), F.lit(".wav")))
    sums = E.manifest(sums, "owner_id", ["file_id"]).select(F.concat(C("owner_id").cast("string"), F.lit("/archive.zip")).alias("name"), F.lit("batch_summaries.txt").alias("member"), F.lit(-1).cast("long").alias("job"), F.lit(0).cast("long").alias("place"), F.encode("content", "utf-8").alias("content"))
    at = folders.new(spark, "artifacts")
    files.write(lines.unionByName(members_).unionByName(sums), at, ["job", "place"])
    return shown_files(partial(reread, spark, at, "owner_id"), "owner_id")


def local_transcripts(spark, sf) -> DataFrame:
    """The local rendering of transcripts: table, workbook and texts of each file, written to its folder and read again."""
    produced = Produced(spark, sf)
    some = [k for k in E.MEMBERS if k.startswith("trans")]
    made = E.archive_rows(produced.rendered().where(C("artifact").isin(*some)), F.concat_ws("/", "file_id", "file_id"))
    at = folders.new(spark, "local")
    files.write(made.select(C("member").alias("name"), "place", "content"), at, ["place"])
    found = lambda only=(), but=(): files.contents(spark, at, only, but).select(F.substring_index("name", "/", 1).cast("long").alias("file_id"), C("name").alias("artifact"), "content")
    return shown_files(found, "file_id").select(C("artifact").alias("name"), "shown")


def local_files(spark, sf) -> DataFrame:
    """Pages written under their local paths and read again: path, size and hash of each."""
    named = texts.names(spark, sf).withColumn("name", F.concat_ws("_", "page_id", "name"))
    path = X.local_path(X.safe_name(C("name")), F.lit("words"), F.when(C("page_id") % 2 == 0, "de"), "csv")
    rows = named.select("page_id", path.alias("name")).join(D.table(spark, sf, "pages").select("page_id", C("html").alias("content")), "page_id")
    at = folders.new(spark, "local")
    files.write(rows, at, ["page_id"])
    return files.read(spark, at).select(C("name").alias("path"), C("length").alias("size"), F.sha2("content", 256).alias("digest"))


def api(spark, sf) -> DataFrame:
    """What a job's address gives, as JSON: even files were translated, every eleventh job is still running, silent ones were
    skipped."""
    produced = Produced(spark, sf)
    k = C("file_id")
    ids = D.table(spark, sf, "conversations").select(C("conv_id").alias("file_id")).distinct()
    jobs = ids.select(
        "file_id", (k % 11 != 10).alias("completed"), (k % 7 == 0).alias("skipped"), F.when(k % 7 == 0, "no speech").alias("skip_reason"),
        F.when(k % 2 == 0, "translate").otherwise("transcribe").alias("task"), F.when(k % 2 == 0, "en").otherwise("de").alias("transcript_language"),
        F.lit("de").alias("resolved_src_lang"), (k % 7 != 0).alias("has_cloud"), (k % 10 == 1).alias("has_frames"),
    )
    return E.api_documents(jobs, produced.transcript, produced.words, produced.entities, produced.findings, produced.summaries)


API = """SELECT file_id, CASE WHEN file_id % 11 <> 10 THEN to_json({'transcript': coalesce(t, []), 'transcript_language': CASE WHEN file_id % 2 = 0 THEN 'en' ELSE 'de' END, 'resolved_src_lang': 'de', 'summary': summary,
  'word_counts': w, 'named_entities': e, 'wordcloud_url': CASE WHEN file_id % 7 <> 0 THEN '/api/v1/jobs/' || file_id || '/artifacts/wordcloud.png' END,
  'keyframes_url': CASE WHEN file_id % 10 = 1 THEN '/api/v1/jobs/' || file_id || '/artifacts/keyframes.zip' END, 'hate_speech_findings': h, 'skipped': file_id % 7 = 0,
  'skip_reason': CASE WHEN file_id % 7 = 0 THEN 'no speech' END, 'task': CASE WHEN file_id % 2 = 0 THEN 'translate' ELSE 'transcribe' END})::VARCHAR END AS document
FROM (SELECT DISTINCT conv_id AS file_id FROM conversations)
LEFT JOIN (SELECT file_id, list({'start': start, 'end': "end", 'speaker': speaker, 'text': text, 'translation': translation} ORDER BY row_idx) AS t FROM loud GROUP BY file_id) USING (file_id)
LEFT JOIN (SELECT file_id, list({'word': word, 'count': frequency} ORDER BY rank) AS w FROM top GROUP BY file_id) USING (file_id)
LEFT JOIN (SELECT file_id, list({'entity': entity, 'category': category, 'frequency': frequency} ORDER BY rank) AS e FROM found GROUP BY file_id) USING (file_id)
LEFT JOIN (SELECT file_id, list({'hate_speech': true, 'category': category, 'confidence': confidence, 'reason': reason, 'text': text, 'start': start} ORDER BY row_idx) AS h FROM flagged GROUP BY file_id) USING (file_id)
LEFT JOIN summaries USING (file_id)"""


def frames(spark, sf) -> DataFrame:
    e = D.job_events(spark, sf)
    payload = F.to_json(F.struct("job_id", "stage_index"))
    return e.select("job_id", "seq", J.frame(C("event"), payload).alias("frame"))


FRAMES = """SELECT job_id, seq, 'event: ' || event || chr(10) || 'data: {"job_id":' || job_id || CASE WHEN stage_index IS NOT NULL THEN ',"stage_index":' || stage_index ELSE '' END || '}' || chr(10) || chr(10) AS frame FROM job_events"""


def parsed(spark, sf) -> DataFrame:
    """Frames of each job as one stream of bytes, cut amid every frame: a chunk has the end of one frame and the beginning of
    the next. The chunks come in four micro-batches, not in their order, and the frames are put together and parsed."""
    by = Window.partitionBy("job_id").orderBy("seq")
    before, after = F.coalesce(F.substr(F.lag("frame").over(by), F.lit(10)), F.lit("")), F.when(F.lead("seq").over(by).isNull(), F.substr("frame", F.lit(10))).otherwise("")
    chunks = frames(spark, sf).select(C("job_id").alias("stream_id"), "seq", F.concat(before, F.substring("frame", 1, 9), after).alias("chunk"))
    at = folders.new(spark, "stream")
    log = in_parts(spark, chunks, f"{at}/log", "pmod(seq * 7, 4)")
    S.fan_out(U.frames(log), {"raw": f"{at}/raw"}, f"{at}/state", "append").trigger(availableNow=True).start().awaitTermination()
    whole = J.parsed_raw(spark.read.schema(U.RAW).parquet(f"{at}/raw"))
    return J.known_events(whole).select("stream_id", "frame_idx", "event", F.get_json_object("data", "$.job_id").alias("job"))


def written(spark, sf, kind: str) -> DataFrame:
    """Rows written by a sink and read again: what comes back is what went in."""
    at = folders.new(spark, f"sink-{kind}")
    if kind == "csv":
        t = texts.top_words(spark, sf).select("file_id", "rank", "word", "frequency")
        E.write_table(t, at, ["file_id", "rank"])
        return spark.read.schema(t.schema).option("header", True).csv(at)
    E.write_lines(records(spark, sf), at, ["file_id", "sentence_index"])
    return spark.read.text(at).select(F.get_json_object("value", "$.sentence_index").cast("long").alias("sentence_index"), F.get_json_object("value", "$.text").alias("text"))


def archived(spark, sf) -> DataFrame:
    """Zips of each job's transcript and word table, unpacked again: members in order, with what they hold."""
    text = blocks(spark, sf).select(C("file_id").alias("job_id"), F.lit(0).alias("pos"), F.concat(C("file_id").cast("string"), F.lit("_transcript.txt")).alias("member"), F.encode("content", "utf-8").alias("content"))
    lines = E.lines_file(records(spark, sf)).select(C("file_id").alias("job_id"), F.lit(1).alias("pos"), F.concat(C("file_id").cast("string"), F.lit("_segments.jsonl")).alias("member"), F.encode("content", "utf-8").alias("content"))
    return E.unpacked(E.archives(text.unionByName(lines))).select("job_id", "pos", "member", F.decode("content", "utf-8").alias("content"))


# jobs and streams


def folded(spark, sf) -> DataFrame:
    return J.fold(D.job_events(spark, sf))


FOLDED = """folded AS (SELECT owner_id, job_id, coalesce(max(CASE event WHEN 'job_completed' THEN 'completed' WHEN 'job_failed' THEN 'failed' END), 'running') AS status,
  coalesce(max(stage_index), 0) AS stage_index, CASE WHEN count_if(event = 'job_completed') = 0 THEN
    ['Transcribing', 'Translating', 'Running word-level analysis', 'Summarizing', 'Detecting hate speech'][arg_max(stage_index, CASE WHEN stage_index IS NOT NULL THEN seq END) + 1] END AS stage,
  CASE WHEN count_if(event = 'job_completed') > 0 THEN 1.0::DOUBLE ELSE max(progress) END AS progress FROM job_events GROUP BY owner_id, job_id)"""


def with_folded(sql: str) -> str:
    return ONE("", "jobs").rstrip() + f",\n{FOLDED},\nlive AS (SELECT * FROM folded WHERE job_id % 3 <> 0),\nover AS (SELECT j.owner_id, j.job_id, j.created_at, j.file_name, coalesce(l.status, j.status) AS status, l.stage AS live_stage, l.progress AS live_progress FROM jobs j LEFT JOIN live l USING (job_id))\n" + sql


def in_slots(spark, sf) -> DataFrame:
    """Progress of all jobs, folded by five jobs of which two run at a time, each for the owners of one part of the log. The
    last, while it waits, is deleted and sent again."""
    at = folders.new(spark, "parts")
    D.job_events(spark, sf).withColumn("part", F.pmod("owner_id", F.lit(5))).write.partitionBy("part").parquet(at)
    log = spark.read.parquet(at)
    slots = Slots(spark, 2)
    work = {str(k): J.fold(log.where(C("part") == k)).withColumn("part", F.lit(k)) for k in range(5)}
    for name, rows in work.items():
        slots.submit(name, rows.withColumn("attempt", F.lit(1)))
    slots.delete("4")
    slots.submit("4", work["4"].withColumn("attempt", F.lit(2)))
    parts = [slots.result(name) for name in slots.finish()]
    return reduce(DataFrame.unionByName, parts).select("part", "attempt", "owner_id", "job_id", "status", "progress")


def overlaid(spark, sf) -> DataFrame:
    return J.overlaid(D.jobs(spark, sf), folded(spark, sf).where("job_id % 3 <> 0"))


def counted(spark, sf) -> DataFrame:
    return J.counts(overlaid(spark, sf))


COUNTED = "SELECT owner_id, count_if(status = 'running')::BIGINT AS processing, count_if(status = 'queued')::BIGINT AS queued, count_if(status = 'completed')::BIGINT AS finished, count_if(status NOT IN ('running', 'queued', 'completed'))::BIGINT AS failed, count(*) AS total FROM over GROUP BY owner_id"


def ranked(spark, sf, newest: bool) -> DataFrame:
    """Jobs with their place in an owner's list."""
    order = C("created_at").desc() if newest else C("created_at").asc()
    return J.occurrence(D.jobs(spark, sf), ["owner_id"], [order, "job_id"]).select("owner_id", "job_id", C("occurrence").alias("pos"))


def seeds(spark, sf) -> DataFrame:
    status, error = J.seeded(C("status"), F.when(C("job_id") % 2 == 0, "broke"))
    return D.jobs(spark, sf).select("job_id", status.alias("status"), error.alias("error"))


SEEDS = ONE("SELECT job_id, CASE status WHEN 'interrupted' THEN 'failed' WHEN 'queued' THEN 'queued' ELSE status END AS status, CASE WHEN status = 'queued' THEN NULL WHEN job_id % 2 = 0 THEN 'broke' WHEN status = 'interrupted' THEN 'interrupted' END AS error FROM jobs", "jobs")


def tabs(spark, sf) -> DataFrame:
    r = results(spark, sf)
    made = F.array_compact(F.array(F.when(C("has_transcript"), "transcript"), F.when(~X.is_blank(C("summary")), "summary"), F.when(C("has_words"), "words"), F.when(C("has_words"), "wordcloud"), F.when(C("has_entities"), "entities"), F.when(C("has_findings"), "hate_speech")))
    return r.select("job_id", F.array_join(made, ",").alias("tabs"))


def submissions(spark, sf) -> DataFrame:
    j = D.jobs(spark, sf).where("status = 'failed'")
    return j.select("job_id", F.concat("file_name", F.lit(": "), F.lit("rejected")).alias("message"))


def undeleted(spark, sf) -> DataFrame:
    """Events of jobs in four parts, between the second and the third of which cancelled jobs are deleted while they run: what
    is left of each owner's events once the jobs that were closed are gone, and how many were closed."""
    at = folders.new(spark, "stream")
    gone = D.jobs(spark, sf).where("status = 'cancelled'").select("owner_id", "job_id")
    log = folders.keep(D.job_events(spark, sf).withColumn("stage_index", C("stage_index").cast("long")))
    gone.limit(0).write.parquet(f"{at}/gone")
    for part in range(4):
        log.where(f"{PART} = {part}").write.mode("append").parquet(f"{at}/log")
        if part == 2:
            gone.write.mode("append").parquet(f"{at}/gone")
        events, tombstones = S.read(spark, f"{at}/log", log.schema, ALL), S.read(spark, f"{at}/gone", gone.schema, ALL)
        S.fan_out(U.undeleted(events, tombstones, forget_ms=None), {"out": f"{at}/out"}, f"{at}/state", "append").trigger(availableNow=True).start().awaitTermination()
    each = spark.read.schema(U.PASSED).parquet(f"{at}/out").groupBy("owner_id", "job_id").agg(F.count_if(C("event") != U.DELETED).alias("events"), F.count_if(C("event") == U.DELETED).alias("deleted"), F.count_if((C("event") != U.DELETED) & (C("seq") >= 6)).alias("late"))
    # of a deleted job nothing may have passed after its tombstone
    left = F.when(C("deleted") == 0, C("events")).otherwise(0)
    return each.groupBy("owner_id").agg(F.sum(left).alias("events"), F.sum("deleted").alias("deleted"), F.sum(F.when(C("deleted") > 0, C("late")).otherwise(0)).alias("unseen"))


#: Files of a folder that one run of a stream takes, and the part of the log that an event is in.
ALL = 1_000_000
PART = "least(floor(seq / 3), 3)"


def in_parts(spark, rows: DataFrame, at: str, part: str) -> DataFrame:
    """rows, appended to a log in four parts, and read as a stream, a part a micro-batch or so; each part has as many files
    as it has tasks."""
    rows = folders.keep(rows)
    for k in range(4):
        rows.where(f"{part} = {k}").write.mode("append").parquet(at)
    files = max(1, len(spark.read.schema(rows.schema).parquet(at).inputFiles()) // 4)
    return S.read(spark, at, rows.schema, files_a_batch=files)


def event_log(spark, sf, at: str, part: str = PART) -> DataFrame:
    """The job events as a stream in four parts, in the order of seq unless `part` says otherwise."""
    return in_parts(spark, D.job_events(spark, sf).withColumn("stage_index", C("stage_index").cast("long")), f"{at}/log", part)


def history(spark, sf) -> DataFrame:
    """Events of known names, appended batch by batch to the history, and read from it."""
    at = folders.new(spark, "stream")
    S.fan_out(S.known(event_log(spark, sf, at)), {"history": f"{at}/history"}, f"{at}/state", "append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(D.job_events(spark, sf).withColumn("stage_index", C("stage_index").cast("long")).schema).parquet(f"{at}/history")


def job_stream(spark, sf) -> DataFrame:
    """What a subscriber of each job gets: its events in order, each once, up to the one that ends it, although all come
    twice and many come late."""
    at = folders.new(spark, "stream")
    log = event_log(spark, sf, at, "pmod(seq * 7, 4)")
    S.fan_out(U.tail(log.unionByName(log), idle_ms=None), {"frames": f"{at}/frames"}, f"{at}/state", "append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(S.FRAMES).parquet(f"{at}/frames").select("job_id", "seq", "event", "closes")


def owner_stream(spark, sf) -> DataFrame:
    """What a subscriber of each owner gets who connects after the second of four parts of the log: the history, the oldest job
    first, then live what comes, within a part by time. The stream is stopped after each part and starts again."""
    at = folders.new(spark, "stream")
    log = folders.keep(D.job_events(spark, sf).withColumn("stage_index", C("stage_index").cast("long")))
    owners = log.groupBy("owner_id").agg(F.max("ts").alias("ts"))
    owners.limit(0).write.parquet(f"{at}/connections")
    for part in range(4):
        log.where(f"{PART} = {part}").write.mode("append").parquet(f"{at}/log")
        if part == 1:
            owners.write.mode("append").parquet(f"{at}/connections")
        events, connections = S.read(spark, f"{at}/log", log.schema, ALL), S.read(spark, f"{at}/connections", owners.schema, ALL)
        S.fan_out(U.owner_tail(events, connections), {"out": f"{at}/out"}, f"{at}/state", "append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(U.OWNED).parquet(f"{at}/out").select("owner_id", "place", "job_id", "event", "live")


def streamed(spark, sf) -> DataFrame:
    """The event log read as a stream of files, folded with keyed state, last state a job; as the batch fold."""
    at = folders.new(spark, "stream")
    S.fan_out(S.progress(event_log(spark, sf, at)), {"all": f"{at}/all"}, f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    states = spark.read.schema(S.PROGRESS).parquet(f"{at}/all")
    return states.groupBy("owner_id", "job_id").agg(F.max_by(F.struct("status", "stage_index", "stage", "progress"), "seq").alias("s")).select("owner_id", "job_id", "s.*")


def books(spark, sf) -> DataFrame:
    """A workbook for each file's most frequent words, unpacked again: the cells of its sheet, row by row."""
    t = texts.top_words(spark, sf).select("file_id", "rank", "word", "frequency")
    made = E.workbooks(t, "file_id", ["word", "frequency"], "rank").select("file_id", C("content").alias("archive"))
    sheet = E.unpacked(made, "file_id").where("member = 'xl/worksheets/sheet1.xml'").withColumn("xml", F.decode("content", "utf-8"))
    cells = F.regexp_extract_all("xml", F.lit("<(?:t xml:space=\"preserve\"|v)>([^<]*)<"), F.lit(1))
    return sheet.select("file_id", F.array_join(cells, " ").alias("cells"))


def fanned(spark, sf) -> DataFrame:
    """Ended jobs from the sink of terminal states, that a fan-out of the progress stream writes beside the one of all."""
    at = folders.new(spark, "stream")
    S.fan_out(S.progress(event_log(spark, sf, at)), {"all": f"{at}/all", "terminal": f"{at}/terminal"}, f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(S.PROGRESS).parquet(f"{at}/terminal").select("job_id", "status")


def once(spark, sf) -> DataFrame:
    """One terminal event a job from a stream in which every event comes twice, as after a reconnect."""
    at = folders.new(spark, "stream")
    events = folders.keep(D.job_events(spark, sf))
    log = S.read(spark, folders.path_of(events), events.schema, ALL)
    ended = S.first_terminal(log.unionByName(log)).select("job_id", "event")
    ended.writeStream.outputMode("append").format("parquet").option("path", f"{at}/once").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("job_id long, event string").parquet(f"{at}/once")


#: Of a file of which the first chunk fails, the entities after its 512 words.
ENTITIES = ONE(f"""SELECT file_id, 'PERSON' AS category, entity, count(*) AS frequency, row_number() OVER (PARTITION BY file_id ORDER BY min(i)) AS rank FROM (
  SELECT file_id, unnest(l) AS entity, generate_subscripts(l, 1) AS i FROM (SELECT file_id, {texts.CAPITALS.format("(" + _UNSEEN + ")")} AS l FROM (
    SELECT file_id, string_agg(text, ' ' ORDER BY seg_idx) AS text FROM segments GROUP BY file_id))) GROUP BY file_id, entity""", "segments")
JOBS = lambda sql: ONE(sql, "jobs")
EVENTS = lambda sql: ONE(sql, "job_events")
LIST = lambda f: (lambda s, d: f(D.jobs(s, d)))
LOG = lambda f: (lambda s, d: f(D.job_events(s, d)))
QUERIES = {
    "snk_txt_blocks": (blocks, with_timed(BLOCKS.format("text", ""))),
    "snk_txt_split": (lambda s, d: E.split_texts(timed(s, d)), with_timed("SELECT file_id, 'transcript' AS label, content FROM (" + BLOCKS.format("text", "") + ") UNION ALL SELECT file_id, 'translation', content FROM (" + BLOCKS.format("translation", "WHERE has_translation") + ")")),
    "snk_jsonl_rows": (lambda s, d: record_rows(s, d).select("file_id", "row_idx", "start_seconds", "end_seconds"), with_lines("SELECT file_id, row_idx, s AS start_seconds, e AS end_seconds FROM stamped")),
    "snk_jsonl_record": (records, with_lines("SELECT * FROM lines")),
    "snk_jsonl_file": (lambda s, d: E.lines_file(records(s, d)), with_lines("SELECT file_id, string_agg(line, chr(10) ORDER BY sentence_index) || chr(10) AS content FROM lines GROUP BY file_id")),
    "snk_jsonl_job": (job_lines, with_lines("SELECT file_id AS job_id, file_id || '_segments.jsonl' AS name, string_agg(line, chr(10) ORDER BY sentence_index) || chr(10) AS content FROM lines GROUP BY file_id")),
    "snk_jsonl_batch": (batch_lines, with_lines("SELECT file_id // 10 AS owner_id, row_number() OVER (PARTITION BY file_id // 10 ORDER BY file_id, sentence_index) AS place, line FROM lines")),
    "snk_jsonl_atomic": (lambda s, d: written(s, d, "lines"), with_lines("SELECT sentence_index, text FROM stamped")),
    "snk_csv": (lambda s, d: written(s, d, "csv"), f"WITH {texts.TOKENS} SELECT file_id, rank, word, frequency FROM top"),
    "snk_archive_members": (members, with_members("SELECT owner_id, job_id, stem, member, pos FROM members")),
    "snk_archive_job": (lambda s, d: members(s, d).select("job_id", F.concat("stem", F.lit("/"), "member").alias("name")), with_members("SELECT job_id, stem || '/' || member AS name FROM members")),
    "snk_folder_dedupe": (lambda s, d: placed(s, d).select("job_id", "folder"), with_members("SELECT job_id, folder FROM placed")),
    "win_occurrence_no": (lambda s, d: placed(s, d).select("job_id", "stem", "occurrence"), with_members("SELECT job_id, stem, n AS occurrence FROM placed")),
    "snk_archive_batch": (batch, with_members("SELECT owner_id, folder || '/' || member AS name FROM members JOIN placed USING (owner_id, job_id) UNION ALL SELECT DISTINCT owner_id, 'batch_summaries.txt' FROM results WHERE job_id % 3 = 1")),
    "snk_summary_manifest": (manifest, with_members("SELECT owner_id, string_agg(repeat('=', 40) || chr(10) || file_name || chr(10) || repeat('=', 40) || chr(10) || chr(10) || 'Sum of ' || job_id || chr(10), chr(10) ORDER BY created_at, job_id) AS content FROM results WHERE job_id % 3 = 1 GROUP BY owner_id")),
    "snk_zip": (archived, with_lines("SELECT file_id AS job_id, 0::BIGINT AS pos, file_id || '_transcript.txt' AS member, content FROM (" + BLOCKS.format("text", "") + ") UNION ALL SELECT file_id, 1, file_id || '_segments.jsonl', string_agg(line, chr(10) ORDER BY sentence_index) || chr(10) FROM lines GROUP BY file_id")),
    "snk_json_api": (api, with_produced(API)),
    "ml_entities": (lambda s, d: counts.entity_tally(counts.entities(counts.recognised(speech.file_text(s, d), texts.capital_pairs))), ENTITIES),
    "agg_stage_observed": (stage_figures, with_produced(STAGE_FIGURES)),
    "snk_sse": (frames, EVENTS(FRAMES)),
    "st_frame_parse": (parsed, EVENTS("SELECT job_id AS stream_id, row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1 AS frame_idx, event, job_id::VARCHAR AS job FROM job_events")),
    "st_event_parse": (lambda s, d: parsed(s, d).groupBy("event").agg(F.count("*").alias("n")), EVENTS("SELECT event, count(*) AS n FROM job_events GROUP BY event")),
    "st_event_log": (lambda s, d: history(s, d).groupBy("owner_id", "job_id").agg(F.count("*").alias("events"), F.max("seq").alias("last")), EVENTS("SELECT owner_id, job_id, count(*) AS events, max(seq) AS last FROM job_events GROUP BY ALL")),
    "st_job_stream": (job_stream, EVENTS("SELECT job_id, seq, event, event IN ('job_completed', 'job_failed') AS closes FROM job_events")),
    "st_owner_stream": (owner_stream, EVENTS("""SELECT owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY step, CASE WHEN step = 1 THEN created ELSE ts END, job_id, seq) AS place, job_id, event, step > 1 AS live
      FROM (SELECT *, greatest(1, least(seq // 3, 3)) AS step, min(ts) OVER (PARTITION BY owner_id, job_id) AS created FROM job_events)""")),
    "st_owner_replay": (lambda s, d: S.replay(history(s, d)).select("owner_id", "place", "job_id", "event"), EVENTS("SELECT owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY created, job_id, seq) AS place, job_id, event FROM (SELECT *, min(ts) OVER (PARTITION BY job_id) AS created FROM job_events)")),
    "st_progress_fold": (folded, with_folded("SELECT * FROM folded")),
    "st_progress_state": (streamed, with_folded("SELECT * FROM folded")),
    "st_replay": (LOG(lambda e: J.fold(e.unionByName(e))), with_folded("SELECT * FROM folded")),
    "st_delete": (undeleted, JOBS("""SELECT owner_id, count_if(status <> 'cancelled')::BIGINT AS events, count(DISTINCT CASE WHEN status = 'cancelled' THEN job_id END) AS deleted, 0::BIGINT AS unseen
      FROM job_events JOIN jobs USING (owner_id, job_id) GROUP BY owner_id""")),
    "flt_owner": (LIST(lambda j: j.where("owner_id = 7").select("job_id", "status")), JOBS("SELECT job_id, status FROM jobs WHERE owner_id = 7")),
    "flt_completed": (LIST(lambda j: j.where("status = 'completed'").select("owner_id", "job_id")), JOBS("SELECT owner_id, job_id FROM jobs WHERE status = 'completed'")),
    "prj_list_item": (LIST(lambda j: j.select("job_id", "status", "file_name")), JOBS("SELECT job_id, status, file_name FROM jobs")),
    "prj_clearable": (LIST(lambda j: j.select("job_id", C("status").isin("queued", "running").alias("active"))), JOBS("SELECT job_id, status IN ('queued', 'running') AS active FROM jobs")),
    "prj_seed_status": (seeds, SEEDS),
    "prj_tabs": (tabs, with_members("SELECT job_id, concat_ws(',', CASE WHEN job_id % 5 <> 0 THEN 'transcript' END, CASE WHEN job_id % 3 = 1 THEN 'summary' END, CASE WHEN job_id % 2 = 1 THEN 'words,wordcloud' END, CASE WHEN job_id % 6 = 2 THEN 'entities' END, CASE WHEN job_id % 8 = 4 THEN 'hate_speech' END) AS tabs FROM results")),
    "prj_submit_errors": (submissions, JOBS("SELECT job_id, file_name || ': rejected' AS message FROM jobs WHERE status = 'failed'")),
    "join_live_overlay": (lambda s, d: overlaid(s, d).select("job_id", "status", "live_stage", "live_progress"), with_folded("SELECT job_id, status, live_stage, live_progress FROM over")),
    "agg_job_counts": (counted, with_folded(COUNTED)),
    "agg_batch_progress": (lambda s, d: J.batch_progress(counted(s, d)).select("owner_id", "percent"), with_folded(f"SELECT owner_id, floor(100 * (finished + failed) / total + 0.5)::BIGINT AS percent FROM ({COUNTED})")),
    "agg_running_first": (lambda s, d: J.running_first(overlaid(s, d)), with_folded("SELECT owner_id, job_id, file_name, live_stage AS stage, coalesce(live_progress, 0)::DOUBLE AS progress FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, job_id) AS n FROM over WHERE status = 'running') WHERE n = 1")),
    "agg_completed": (lambda s, d: counted(s, d).select("owner_id", C("finished").alias("completed")), with_folded(f"SELECT owner_id, finished AS completed FROM ({COUNTED})")),
    "agg_clear_result": (LIST(lambda j: j.groupBy("owner_id").agg(F.count_if(C("status") != "failed").alias("cleared"), F.count_if(C("status") == "failed").alias("failed"))), JOBS("SELECT owner_id, count_if(status <> 'failed')::BIGINT AS cleared, count_if(status = 'failed')::BIGINT AS failed FROM jobs GROUP BY owner_id")),
    "sort_jobs_newest": (lambda s, d: ranked(s, d, True), JOBS("SELECT owner_id, job_id, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, job_id) AS pos FROM jobs")),
    "sort_jobs_oldest": (lambda s, d: ranked(s, d, False), JOBS("SELECT owner_id, job_id, row_number() OVER (PARTITION BY owner_id ORDER BY created_at, job_id) AS pos FROM jobs")),
}
QUERIES |= {
    "snk_xlsx": (books, f"WITH {texts.TOKENS} SELECT file_id, 'word frequency ' || string_agg(word || ' ' || frequency, ' ' ORDER BY rank) AS cells FROM top GROUP BY file_id"),
    "snk_transcript_local": (local_transcripts, with_produced(f"SELECT file_id || '/' || file_id || ending AS name, shown FROM single JOIN {ORDER} USING (artifact) WHERE artifact LIKE 'trans%'")),
    "snk_local_dir": (local_files, "WITH " + texts.FILES + f", safe AS (SELECT page_id, {texts.SAFE.format("(page_id || '_' || name)")} AS name FROM files), stems AS (SELECT page_id, {texts.STEM} AS stem FROM safe) SELECT 'output/' || stem || '/' || stem || '_words' || CASE WHEN page_id % 2 = 0 THEN '_de' ELSE '' END || '.csv' AS path, strlen(html) AS size, sha256(html) AS digest FROM stems JOIN pages USING (page_id)"),
    "snk_artifact": (artifact_files, with_produced(ARTIFACT_BYTES)),
    "snk_artifact_batch": (batch_artifact_files, with_produced(BATCH_BYTES)),
    "snk_artifact_names": (lambda s, d: E.artifacts(results(s, d).withColumn("has_summary", C("job_id") % 3 == 1)).select("job_id", "artifact", "media_type"), with_members(ARTIFACTS)),
    "snk_artifact_batch_names": (lambda s, d: E.artifacts(results(s, d)).where(C("artifact").isin(*E.BATCH_ARTIFACTS)).select("job_id", "artifact"), with_members(f"SELECT job_id, artifact FROM ({ARTIFACTS}) WHERE artifact IN ('archive.zip', 'segments.jsonl')")),
    "st_concurrency": (in_slots, with_folded("SELECT (owner_id % 5)::INTEGER AS part, CASE WHEN owner_id % 5 = 4 THEN 2 ELSE 1 END AS attempt, owner_id, job_id, status, progress FROM folded")),
    "st_fanout": (fanned, with_folded("SELECT job_id, status FROM folded WHERE status <> 'running'")),
    "st_reconnect": (once, EVENTS("SELECT job_id, event FROM job_events WHERE event IN ('job_completed', 'job_failed')")),
}
