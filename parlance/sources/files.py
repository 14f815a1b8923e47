"""A sink of whole files, by the data source interface: each name's rows become one file, and a run's files appear at once.

A task writes the rows of a name, which follow one another, straight to the file, so it holds one row at a time however long the
file gets. Files of failed attempts and of failed runs never show: attempts write under names of their own, and the folder of
the run takes its place by one rename when all tasks are done."""

from __future__ import annotations

import itertools
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: A file's bytes are its rows' contents in order; rows with a member make it a zip archive of these.
SCHEMA = "name string, member string, content binary"


def filesystem(uri: str):
    """The file system of an address, and the path in it: local folders, or what pyarrow knows by its scheme."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def exists(uri: str) -> bool:
    from pyarrow import fs

    system, path = filesystem(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


@dataclass
class Written(WriterCommitMessage):
    files: int


class WholeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WholeFilesWriter(self.options["path"], overwrite)


class WholeFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.run = f"{self.path}.run-{uuid.uuid4().hex}"
        if not overwrite and exists(self.path):
            raise FileExistsError(self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        system, run = filesystem(self.run)
        own = f"{run}/attempts/{TaskContext.get().taskAttemptId()}"
        last, files = None, 0
        for name, rows in itertools.groupby(iterator, key=lambda r: r["name"]):
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"not a name inside the folder: {name!r}")
            if last is not None and name <= last:
                raise ValueError(f"rows of {name!r} do not come in order of names")
            system.create_dir(own)
            with system.open_output_stream(f"{own}/file") as out:
                fill(out, rows)
            system.create_dir(posixpath.dirname(f"{run}/files/{name}"))
            system.move(f"{own}/file", f"{run}/files/{name}")
            last, files = name, files + 1
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, run = filesystem(self.run)
        _, path = filesystem(self.path)
        system.create_dir(f"{run}/files")
        system.create_dir(posixpath.dirname(path))
        aside = None
        if exists(self.path):
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(self.path)
            aside = f"{run}/replaced"
            system.move(path, aside)
        try:
            system.move(f"{run}/files", path)
        except OSError:
            if aside:
                system.move(aside, path)
            raise
        system.delete_dir(run)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if exists(self.run):
            system, run = filesystem(self.run)
            system.delete_dir(run)


def fill(out, rows: Iterator[Row]) -> None:
    """Rows of one file: bytes one after the other, or members of a zip, each written as it comes."""
    first = next(rows)
    rows = itertools.chain([first], rows)
    if first["member"] is None:
        for r in rows:
            out.write(bytes(r["content"] or b""))
        return
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for r in rows:
            archive.writestr(zipfile.ZipInfo(r["member"], (1980, 1, 1, 0, 0, 0)), bytes(r["content"] or b""), zipfile.ZIP_DEFLATED)


def write(rows: DataFrame, path: str, order: list[str], overwrite: bool = False) -> None:
    """Write rows (name, content, and member for zips) as files under `path`; a file's rows come in the given order. A path
    that exists is an error, unless it is to be overwritten: then it stays until all new files are there."""
    rows.sparkSession.dataSource.register(WholeFiles)
    member = F.col("member") if "member" in rows.columns else F.lit(None).cast("string")
    made = rows.repartition("name").sortWithinPartitions("name", *order).select("name", member.alias("member"), F.col("content").cast("binary").alias("content"))
    made.write.format("whole_files").mode("overwrite" if overwrite else "append").save(path)


def empty_names(path: str) -> list[str]:
    """Names of the files under a path that hold nothing, which Spark's reader passes over. They are listed where Spark lists
    its files too, and only their names are held."""
    from pyarrow import fs

    system, root = filesystem(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return [posixpath.relpath(f.path, root) for f in found if f.type == fs.FileType.File and f.size == 0 and not f.base_name.startswith(("_", "."))]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, content) of all files under a path, empty ones too; what is not selected is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    at = F.regexp_extract("path", r"^[a-z0-9+.-]*:?/*(.*)$", 1)
    root = posixpath.normpath(filesystem(path)[1]).strip("/")
    full = found.select(F.url_decode(F.substr(at, F.lit(len(root) + 2))).alias("name"), "length", "content")
    if none := empty_names(path):
        full = full.unionByName(spark.createDataFrame([(n, 0, b"") for n in none], full.schema))
    return full


def _hidden(name: str) -> bool:
    return any(part.startswith((".", "_")) for part in name.split("/"))


#: What a task of `contents` hands over at a time: bytes, and files.
AT_ONCE, MOST_FILES = 8 << 20, 1000


def contents(spark: SparkSession, path: str, only: tuple[str, ...] = (), but: tuple[str, ...] = ()) -> DataFrame:
    """(name, content) of all files under a path, or of those whose names have one of the ends `only` and none of `but`.

    For many small files: Spark's reader plans a task for every few of them. Here the driver lists what is right under the path;
    tasks get an equal number of these folders and files, and list and read what is in them."""
    from pyarrow import fs

    system, root = filesystem(path)
    tops = [(f.base_name,) for f in system.get_file_info(fs.FileSelector(root)) if not _hidden(f.base_name)]
    parts = max(1, min(len(tops), max(4 * spark.sparkContext.defaultParallelism, len(tops) // 256)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        system, root = filesystem(path)
        names, held, size = [], [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.binary())], ["name", "content"])
        for top in (top for batch in batches for top in batch.column(0).to_pylist()):
            found = [system.get_file_info(f"{root}/{top}")]
            if found[0].type == fs.FileType.Directory:
                found = system.get_file_info(fs.FileSelector(f"{root}/{top}", recursive=True))
            for f in found:
                name = posixpath.relpath(f.path, root)
                if f.type != fs.FileType.File or _hidden(name) or (only and not name.endswith(only)) or (but and name.endswith(but)):
                    continue
                with system.open_input_stream(f.path, compression=None) as file:
                    held.append(file.read())
                names.append(name)
                size += len(held[-1])
                if size >= AT_ONCE or len(names) >= MOST_FILES:
                    yield made()
                    names, held, size = [], [], 0
        if names:
            yield made()

    return spark.createDataFrame(tops, "top string").repartition(parts).mapInArrow(run, "name string, content binary")


def received(spark: SparkSession, path: str, most: int) -> DataFrame:
    """(name, length, accepted, digest) of the files under a path. Those above `most` bytes are refused by their length, which
    the reader tells before it opens them; only the others are read, and have a hash."""
    fine = F.col("length") <= most
    taken = read(spark, path).where(fine).select("name", "length", F.lit(True).alias("accepted"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"))
    refused = read(spark, path).where(~fine).select("name", "length", F.lit(False).alias("accepted"), F.lit(None).cast("string").alias("digest"))
    return taken.unionByName(refused)
