"""Artifacts of many recordings: small files are read and made by the hundred, not by the few."""

import io
import zipfile

from parlance.operators import exports
from parlance.sources import files
from tests.test_sinks import rows


def cells(book):
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        return z.read("xl/worksheets/sheet1.xml").decode()


def test_many_small_files_take_few_tasks(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    some = [(f"{i % 700}/{name}", None, f"{i} {name}") for i in range(700) for name in ("a.txt", "b.xlsx", "c/d.zip")]
    files.write(rows(spark, *some, ("top.txt", None, "é"), ("empty.txt", None, "")), at, ["i"])
    (tmp_path / "out" / "_SUCCESS").write_text("x")
    (tmp_path / "out" / "7" / ".hidden.txt").write_text("x")
    got = files.contents(spark, at)
    # Spark's own reader plans more than a hundred here
    assert got.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism < files.read(spark, at).rdd.getNumPartitions()
    held = lambda df: {r["name"]: bytes(r["content"]).decode() for r in df.collect()}
    wanted = {name: content for name, _, content in some} | {"top.txt": "é", "empty.txt": ""}
    assert held(got) == wanted and got.count() == len(wanted)
    assert held(files.contents(spark, at, only=(".xlsx", ".zip"))) == {k: v for k, v in wanted.items() if not k.endswith(".txt")}
    assert held(files.contents(spark, at, but=(".xlsx", ".zip"))) == {k: v for k, v in wanted.items() if k.endswith(".txt")}


def test_no_files(spark, tmp_path):
    assert files.contents(spark, str(tmp_path)).collect() == []


def test_workbooks_of_many_files(spark):
    """Rows in order, without columns that a file has no values for; whole numbers stay whole beside a missing one."""
    some = [(k, i, f"<w{k}&{i}>", None if i == 1 else 3 * i, None if k % 2 else "x") for k in range(300) for i in (2, 0, 1)]
    made = exports.workbooks(spark.createDataFrame(some, "file_id long, i int, word string, n long, odd string"), "file_id", ["word", "n", "odd"], "i")
    got = {r["file_id"]: cells(bytes(r["content"])) for r in made.collect()}
    wanted = lambda k: exports.sheet(["word", "n"] + ["odd"] * (k % 2 == 0), [(f"<w{k}&{i}>", None if i == 1 else 3 * i, "x")[: 3 - k % 2] for i in range(3)])
    assert got == {k: cells(wanted(k)) for k in range(300)}
    assert "<c><v>6</v></c>" in got[4]


def test_archives_of_many_files_are_unpacked_in_order(spark):
    zips = spark.createDataFrame([(k, bytearray(exports.zipped([(f"{k}/b", "x" * k), (f"{k}/a", "é")]))) for k in range(300)], "job_id long, archive binary")
    got = [tuple(r)[:3] + (bytes(r["content"]).decode(),) for r in exports.unpacked(zips).orderBy("job_id", "pos").collect()]
    assert got == [x for k in range(300) for x in ((k, 0, f"{k}/b", "x" * k), (k, 1, f"{k}/a", "é"))]
