"""Renderings of transcripts: text blocks, JSON Lines, tables, archives and their names."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from functools import reduce
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import text as X
from parlance.sources import folders
from parlance.sources.derived import in_order

RULE = "=" * 40
#: Bytes of members that are handed over at a time, and workbooks.
AT_ONCE, BOOKS = 8 << 20, 100


def block(start: Column, end: Column, speaker: Column, text: Column) -> Column:
    """One row as a readable block: a fenced header with times and, if there is one, the speaker; then the text."""
    shown = F.when(~X.is_blank(speaker), F.concat(F.lit("  "), speaker)).otherwise("")
    header = F.concat(F.lit("["), F.coalesce(start, F.lit("")), F.lit(" - "), F.coalesce(end, F.lit("")), F.lit("]"), shown)
    return F.concat(F.lit(RULE + "\n"), header, F.lit("\n" + RULE + "\n"), F.coalesce(text, F.lit("")))


def text_blocks(transcript: DataFrame, text: str = "text") -> DataFrame:
    """(file_id, content): a file's rows as blocks, a blank line between them, one line break at the end."""
    made = transcript.withColumn("block", block(F.col("start"), F.col("end"), F.col("speaker"), F.col(text)))
    return made.groupBy("file_id").agg(F.concat(in_order("block", "row_idx", "\n\n"), F.lit("\n")).alias("content"))


def split_texts(transcript: DataFrame) -> DataFrame:
    """(file_id, label, content): `transcript` for every file and `translation` for those that have one."""
    one = text_blocks(transcript).withColumn("label", F.lit("transcript"))
    two = text_blocks(transcript.where("has_translation"), "translation").withColumn("label", F.lit("translation"))
    return one.unionByName(two).select("file_id", "label", "content")


def record_rows(transcript: DataFrame) -> DataFrame:
    """Rows with start_seconds and end_seconds read from the clock texts; rows whose times cannot be read are skipped."""
    timed = transcript.withColumn("start_seconds", X.parse_clock(F.col("start"))).withColumn("end_seconds", X.parse_clock(F.col("end")))
    return timed.where("start_seconds is not null and end_seconds is not null")


def json_text(value: Column) -> Column:
    """A string as a JSON literal, letters unescaped; null as null."""
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)\A\{"v":(.*)\}\z', 1), F.lit("")).try_cast("string")


def record(hash_: Column, language: Column, index: Column, start: Column, end: Column, speaker: Column, text: Column, file: Column) -> Column:
    """One JSON object with its keys in fixed order: the hash and the speaker only if set, the language also if null."""
    literal = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(json_text(c))
    optional = lambda key, c: F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit(f'"{key}": '), json_text(c), F.lit(", ")))
    spoken = F.when(~X.is_blank(speaker), X.strip(speaker))
    return F.concat(
        F.lit('{"source_file": '), literal(file), F.lit(", "), optional("source_file_hash", hash_), F.lit('"language": '), literal(language),
        F.lit(', "sentence_index": '), index.cast("string"), F.lit(', "start_seconds": '), start.cast("string"), F.lit(', "end_seconds": '), end.cast("string"),
        F.lit(', "start_ts": "'), X.stamp(start), F.lit('", "end_ts": "'), X.stamp(end), F.lit('", '), optional("speaker", spoken), F.lit('"text": '), literal(text), F.lit("}"),
    )


def records(rows: DataFrame) -> DataFrame:
    """(file_id, sentence_index, line) from rows with file_name, file_hash and language, numbered from 0 in row order."""
    index = (F.row_number().over(Window.partitionBy("file_id").orderBy("row_idx")) - 1).cast("long")
    numbered = rows.withColumn("sentence_index", index)
    c = F.col
    line = record(c("file_hash"), c("language"), c("sentence_index"), c("start_seconds"), c("end_seconds"), c("speaker"), c("text"), c("file_name"))
    return numbered.select("file_id", "sentence_index", line.alias("line"))


def lines_file(made: DataFrame) -> DataFrame:
    """(file_id, content): all records of a file, a line break after each."""
    return made.groupBy("file_id").agg(F.concat(in_order("line", "sentence_index", "\n"), F.lit("\n")).alias("content"))


def members(results: DataFrame) -> DataFrame:
    """(job_id, pos, member): archive member names of what a job produced, in fixed order, from flags and a frame count."""
    s = F.col("stem")
    names = [
        ("has_transcript", "_transcript.csv"), ("has_transcript", "_transcript.xlsx"), ("has_transcript", "_transcript.txt"), ("has_translation", "_translation.txt"),
        ("has_summary", "_summary.txt"), ("has_words", "_words.csv"), ("has_words", "_words.xlsx"), ("has_entities", "_entities.csv"), ("has_entities", "_entities.xlsx"),
        ("has_cloud", "_wordcloud.png"), ("has_findings", "_hate_speech.csv"), ("has_findings", "_hate_speech.xlsx"), ("has_transcript", "_segments.jsonl"),
    ]
    plain = F.array_compact(F.array(*(F.when(F.col(flag), F.concat(s, F.lit(end))) for flag, end in names)))
    frames = F.when(F.col("n_frames") > 0, F.transform(F.sequence(F.lit(0), F.col("n_frames").cast("int") - 1), lambda i: F.format_string("keyframes/frame_%03d.jpg", i))).otherwise(F.array().cast("array<string>"))
    keep = [c for c in ("owner_id", "job_id", "stem") if c in results.columns]
    return results.select(*keep, F.posexplode(F.concat(plain, frames)).alias("pos", "member")).withColumn("pos", F.col("pos").cast("long"))


def manifest(jobs: DataFrame, part: str, by: list[str]) -> DataFrame:
    """(part, content): file names and trimmed summaries of the jobs that have one, in order; none gives no row."""
    some = jobs.where(~X.is_blank(F.col("summary")))
    head = F.concat(F.lit(RULE + "\n"), F.col("file_name"), F.lit("\n" + RULE + "\n\n"), X.strip(F.col("summary")), F.lit("\n"))
    made = some.withColumn("entry", head).withColumn("key", F.struct(*by))
    return made.groupBy(part).agg(in_order("entry", "key", "\n").alias("content"))


def write_table(df: DataFrame, path: str, order: list[str], force: bool = False) -> None:
    """CSV files with a header, ranges of rows in order, dealt to tasks. They appear whole and at once; an existing path is an
    error unless forced."""
    made = folders.new(df.sparkSession, "table")
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("header", True).csv(made)
    folders.move(df.sparkSession, made, path, force)


def write_lines(df: DataFrame, path: str, order: list[str], force: bool = False) -> None:
    """Files of text lines, ranges of rows in order, dealt to tasks. They appear whole and at once; an existing path is an
    error unless forced, and stays until the new files are complete."""
    made = folders.new(df.sparkSession, "lines")
    df.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(made)
    folders.move(df.sparkSession, made, path, force)


def sheet(header: list[str], rows: Iterable[tuple]) -> bytes:
    """A workbook of one sheet, `Sheet1`: the smallest OOXML package that holds text and numbers."""
    cell = lambda v: "<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, int | float) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [tuple(header), *rows])
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    start = '<?xml version="1.0" encoding="UTF-8"?>'
    parts = {
        "[Content_Types].xml": f'{start}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'{start}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{start}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{start}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{start}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    return zipped(parts.items())


def zipped(named: Iterable[tuple[str, str | bytes]]) -> bytes:
    """A deflated archive with members in the order given."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in named:
            z.writestr(name, content)
    return out.getvalue()


def archives(files: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, archive): one zip a job from its members (key, pos, member, content as binary), made where the job's rows are.

    A job's members are bounded by one recording's outputs; each job is one group."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        some = pdf.sort_values("pos")
        return pd.DataFrame({key: [some[key].iloc[0]], "archive": [zipped((m, bytes(c)) for m, c in zip(some["member"], some["content"], strict=True))]})

    return files.select(key, "pos", "member", "content").groupBy(key).applyInPandas(run, f"{key} long, archive binary")


def unpacked(zips: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, member, content) of each member of archives (keys, archive), in the order that they hold them."""
    import pandas as pd

    keys = keys or ("job_id",)

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        made, size = [], 0
        shown = lambda: pd.DataFrame(made, columns=[*keys, "pos", "member", "content"])
        for batch in batches:
            for *key, data in zip(*(batch[k] for k in keys), batch["archive"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    for pos, name in enumerate(z.namelist()):
                        made.append((*key, pos, name, z.read(name)))
                        size += len(made[-1][-1])
                if size >= AT_ONCE:  # a frame costs some milliseconds, so it has many small archives
                    yield shown()
                    made, size = [], 0
            if made:
                yield shown()
                made, size = [], 0

    kinds = T.StructType([*(zips.schema[k] for k in keys), *T.StructType.fromDDL("pos long, member string, content binary").fields])
    return zips.select(*keys, "archive").mapInPandas(run, kinds)


def workbooks(tables: DataFrame, key: str, columns: list[str], by: str) -> DataFrame:
    """(key, content): a workbook of one sheet for each key, rows in order, without columns that a key has no values for; a
    key's rows are one file's table."""
    import pyarrow as pa

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), BOOKS):
                some = batch.slice(start, BOOKS)
                made = [book([r["v"] for r in rows.as_py()]) for rows in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(made, pa.binary())], [key, "content"])

    def book(rows: list[dict]) -> bytes:
        rows = [{c: None if v != v else v for c, v in r.items()} for r in rows]
        some = [c for c in columns if any(r[c] is not None for r in rows)]
        return sheet(some, ([r[c] for c in some] for r in rows))

    # rows are gathered by Spark, not as a frame a file, which would cost some milliseconds each
    pairs = F.array_sort(F.collect_list(F.struct(F.col(by).alias("i"), F.struct(*columns).alias("v"))))
    each = tables.groupBy(F.col(key).cast("long").alias(key)).agg(pairs.alias("rows"))
    return each.mapInArrow(run, f"{key} long, content binary")


#: What can be asked for by name, and its media type.
ARTIFACTS = {
    "transcript.csv": "text/csv", "transcript.xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "transcript.txt": "text/plain",
    "translation.txt": "text/plain", "summary.txt": "text/plain", "wordcounts.csv": "text/csv",
    "wordcounts.xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "entities.csv": "text/csv",
    "entities.xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "wordcloud.png": "image/png", "hate_speech.csv": "text/csv",
    "hate_speech.xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "segments.jsonl": "application/x-ndjson",
    "archive.zip": "application/zip", "keyframes.zip": "application/zip",
}
BATCH_ARTIFACTS = {"archive.zip": "application/zip", "segments.jsonl": "application/x-ndjson"}


def artifacts(results: DataFrame) -> DataFrame:
    """(job_id, artifact, media_type): the named outputs that a job has, from the flags of its results."""
    need = {
        "transcript.csv": "has_transcript", "transcript.xlsx": "has_transcript", "transcript.txt": "has_transcript", "translation.txt": "has_translation",
        "summary.txt": "has_summary", "wordcounts.csv": "has_words", "wordcounts.xlsx": "has_words", "entities.csv": "has_entities", "entities.xlsx": "has_entities",
        "wordcloud.png": "has_cloud", "hate_speech.csv": "has_findings", "hate_speech.xlsx": "has_findings", "segments.jsonl": "has_transcript",
    }
    some = F.lit(False)
    for flag in sorted(set(need.values())):
        some = some | F.col(flag)
    frames = F.col("n_frames") > 0
    names = [F.when(F.col(flag), F.lit(name)) for name, flag in need.items()]
    names += [F.when(some | frames, F.lit("archive.zip")), F.when(frames, F.lit("keyframes.zip"))]
    types = F.create_map(*(F.lit(x) for kv in ARTIFACTS.items() for x in kv))
    made = results.select("job_id", F.explode(F.array_compact(F.array(*names))).alias("artifact"))
    return made.withColumn("media_type", F.element_at(types, F.col("artifact")))


def csv_cell(value: Column) -> Column:
    """A value as CSV: in quotes if it holds a comma, a quote or a line break; nothing for null."""
    text = value.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\\r\\n]'), quoted).otherwise(F.coalesce(text, F.lit("")))


def csv_table(rows: DataFrame, columns: dict[str, Column | None], by: str) -> DataFrame:
    """(file_id, content): a file's rows as CSV with a header, in order. A column with a condition is there where it holds,
    which is the same for all rows of a file."""
    head, cells = [], []
    for name, there in columns.items():
        start = F.lit("," if head else "")
        shown = lambda c, there=there, start=start: F.concat(start, c) if there is None else F.when(there, F.concat(start, c)).otherwise("")
        head.append(shown(F.lit(name)))
        cells.append(shown(csv_cell(F.col(name))))
    made = rows.select("file_id", by, F.concat(*head).alias("head"), F.concat(*cells).alias("line"))
    lines = in_order("line", by, "\n")
    return made.groupBy("file_id").agg(F.concat(F.max("head"), F.lit("\n"), lines, F.lit("\n")).alias("content"))


#: Artifacts and the ends of their names in an archive, in its order.
MEMBERS = {
    "transcript.csv": "_transcript.csv", "transcript.xlsx": "_transcript.xlsx", "transcript.txt": "_transcript.txt", "translation.txt": "_translation.txt",
    "summary.txt": "_summary.txt", "wordcounts.csv": "_words.csv", "wordcounts.xlsx": "_words.xlsx", "entities.csv": "_entities.csv",
    "entities.xlsx": "_entities.xlsx", "hate_speech.csv": "_hate_speech.csv", "hate_speech.xlsx": "_hate_speech.xlsx", "segments.jsonl": "_segments.jsonl",
}


def rendered(transcript: DataFrame, words: DataFrame, entities: DataFrame, findings: DataFrame, summaries: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, artifact, content): every artifact that a file has, as bytes; one without rows is not there. Each is bounded
    by one recording. Tables have file_id and their order: row_idx, rank, rank, row_idx, -, sentence_index."""
    text = lambda df, name: df.select("file_id", F.lit(name).alias("artifact"), F.encode("content", "utf-8").alias("content"))
    book = lambda df, name, columns, by: workbooks(df, "file_id", columns, by).select("file_id", F.lit(name).alias("artifact"), "content")
    flagged = findings.select("file_id", "row_idx", F.lit("True").alias("hate_speech"), "category", "confidence", "reason", "text", "start")
    plain = lambda *names: dict.fromkeys(names)
    finding = ["hate_speech", "category", "confidence", "reason", "text", "start"]
    blocks = split_texts(transcript).select("file_id", "content", F.concat("label", F.lit(".txt")).alias("artifact"))
    shown = {"start": None, "end": None, "speaker": F.col("has_speaker"), "text": None, "translation": F.col("has_translation")}
    made = [
        text(csv_table(transcript, shown, "row_idx"), "transcript.csv"), book(transcript, "transcript.xlsx", list(shown), "row_idx"),
        blocks.select("file_id", "artifact", F.encode("content", "utf-8").alias("content")),
        text(summaries.where(~X.is_blank(F.col("summary"))).withColumnRenamed("summary", "content"), "summary.txt"),
        text(csv_table(words, plain("word", "frequency"), "rank"), "wordcounts.csv"), book(words, "wordcounts.xlsx", ["word", "frequency"], "rank"),
        text(csv_table(entities, plain("entity", "category", "frequency"), "rank"), "entities.csv"), book(entities, "entities.xlsx", ["entity", "category", "frequency"], "rank"),
        text(csv_table(flagged, plain(*finding), "row_idx"), "hate_speech.csv"), book(flagged, "hate_speech.xlsx", finding, "row_idx"),
        text(lines_file(lines), "segments.jsonl"),
    ]
    return reduce(DataFrame.unionByName, made)


def archive_rows(files: DataFrame, stem: Column) -> DataFrame:
    """(file_id, place, member, content): artifacts as members of their job's archive, in its order."""
    place = F.array_position(F.array(*map(F.lit, MEMBERS)), F.col("artifact"))
    end = F.element_at(F.create_map(*(F.lit(x) for kv in MEMBERS.items() for x in kv)), F.col("artifact"))
    return files.select("file_id", place.alias("place"), F.concat(stem, end).alias("member"), "content")


def api_documents(jobs: DataFrame, transcript: DataFrame, words: DataFrame, entities: DataFrame, findings: DataFrame, summaries: DataFrame) -> DataFrame:
    """(file_id, document): the JSON that a job's address gives. Jobs have file_id, completed, skipped, skip_reason, task,
    transcript_language, resolved_src_lang, has_cloud and has_frames. A job that is not completed has no result, a skipped one
    an empty transcript; tables without rows are null."""

    def nested(rows: DataFrame, by: str, name: str, *fields: str | Column) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct(F.col(by).alias("i"), F.struct(*fields).alias("v"))))
        return rows.groupBy("file_id").agg(F.transform(pairs, lambda p: p["v"]).alias(name))

    parts = [
        nested(transcript, "row_idx", "transcript", "start", "end", "speaker", "text", "translation"),
        nested(words, "rank", "word_counts", "word", F.col("frequency").alias("count")),
        nested(entities, "rank", "named_entities", "entity", "category", "frequency"),
        nested(findings, "row_idx", "hate_speech_findings", F.lit(True).alias("hate_speech"), "category", "confidence", "reason", "text", "start"),
        summaries.select("file_id", "summary"),
    ]
    met = reduce(lambda a, b: a.join(b, "file_id", "left"), parts, jobs)
    none = F.array().cast(parts[0].schema["transcript"].dataType)
    at = lambda flag, name: F.when(F.col(flag), F.concat(F.lit("/api/v1/jobs/"), F.col("file_id").cast("string"), F.lit("/artifacts/" + name)))
    result = F.struct(
        F.coalesce("transcript", none).alias("transcript"), "transcript_language", "resolved_src_lang", "summary", "word_counts", "named_entities",
        at("has_cloud", "wordcloud.png").alias("wordcloud_url"), at("has_frames", "keyframes.zip").alias("keyframes_url"),
        "hate_speech_findings", "skipped", "skip_reason", "task",
    )
    return met.select("file_id", F.when(F.col("completed"), F.to_json(result, {"ignoreNullFields": "false"})).alias("document"))
