"""What sinks do when they are refused, fail, or replace what is there."""

import zipfile

import pytest

from parlance.operators import exports
from parlance.plans import texts
from parlance.sources import files, folders


def lines(spark, *some):
    return spark.createDataFrame([(i, line) for i, line in enumerate(some)], "i long, line string")


def held(spark, at):
    return sorted(r["value"] for r in spark.read.text(at).collect())


def test_lines_never_replace_a_folder_unasked(spark, tmp_path):
    at = f"{tmp_path}/out"
    exports.write_lines(lines(spark, "a", "b"), at, ["i"])
    with pytest.raises(FileExistsError):
        exports.write_lines(lines(spark, "c"), at, ["i"])
    assert held(spark, at) == ["a", "b"]
    exports.write_lines(lines(spark, "c"), at, ["i"], force=True)
    assert held(spark, at) == ["c"] and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_failed_replacement_leaves_the_old_folder(spark, tmp_path):
    at = f"{tmp_path}/out"
    exports.write_lines(lines(spark, "a"), at, ["i"])
    with pytest.raises(OSError, match="could not rename"):
        folders.move(spark, f"{tmp_path}/never_written", at, True)
    assert held(spark, at) == ["a"]
    failing = lines(spark, "x").selectExpr("i", "raise_error('broken') as line")
    with pytest.raises(Exception, match="broken"):
        exports.write_lines(failing, at, ["i"], force=True)
    assert held(spark, at) == ["a"]


def test_a_prompt_that_no_language_has_is_an_error(spark, tmp_path):
    spark.createDataFrame([(1, "x", "fr"), (2, "y", "de")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["prompt"] for r in texts.prompts(spark, str(tmp_path)).collect()} == {"Translate: {text}", "Fasse zusammen: {text}"}
    with pytest.raises(Exception, match="no prompt for"):
        texts.prompted(spark.createDataFrame([(1, "fr", "poem")], "doc_id long, lang string, key string")).collect()


def rows(spark, *some):
    return spark.createDataFrame([(name, member, i, content) for i, (name, member, content) in enumerate(some)], "name string, member string, i int, content string")


def contents(spark, at):
    return {r["name"]: bytes(r["content"]) for r in files.read(spark, at).collect()}


def test_files_hold_their_rows_in_order(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    some = [(f"{i % 7}/f {i % 3}.txt", None, f"{i};") for i in range(200)]
    files.write(rows(spark, *some), at, ["i"])
    wanted = {}
    for name, _, content in some:
        wanted[name] = wanted.get(name, b"") + content.encode()
    assert contents(spark, at) == wanted
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_archives_are_written_member_by_member(spark, tmp_path):
    at = f"{tmp_path}/out"
    files.write(rows(spark, ("a.zip", "x/1.txt", "one"), ("b.txt", None, "plain"), ("a.zip", "x/ü.txt", "two")), at, ["i"])
    with zipfile.ZipFile(f"{at}/a.zip") as z:
        assert [(n, z.read(n)) for n in z.namelist()] == [("x/1.txt", b"one"), ("x/ü.txt", b"two")]
    assert contents(spark, at)["b.txt"] == b"plain"


def test_files_refuse_a_path_that_exists(spark, tmp_path):
    at = f"{tmp_path}/out"
    files.write(rows(spark, ("a", None, "old")), at, ["i"])
    with pytest.raises(Exception, match="FileExistsError"):
        files.write(rows(spark, ("b", None, "new")), at, ["i"])
    assert contents(spark, at) == {"a": b"old"}
    files.write(rows(spark, ("b", None, "new")), at, ["i"], overwrite=True)
    assert contents(spark, at) == {"b": b"new"} and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_failed_task_leaves_nothing_new(spark, tmp_path):
    at = f"{tmp_path}/out"
    files.write(rows(spark, ("a", None, "old")), at, ["i"])
    broken = rows(spark, *((f"f{i}", None, "x") for i in range(50))).selectExpr("name", "member", "i", "if(i = 49, raise_error('broken'), content) as content")
    for overwrite, path in ((True, at), (False, f"{tmp_path}/other")):
        with pytest.raises(Exception, match="broken"):
            files.write(broken, path, ["i"], overwrite=overwrite)
    assert contents(spark, at) == {"a": b"old"} and [p.name for p in tmp_path.iterdir()] == ["out"]


@pytest.mark.parametrize("name", ["../outside", "/etc/x", "", None])
def test_names_stay_in_the_folder(spark, tmp_path, name):
    with pytest.raises(Exception, match="not a name inside the folder"):
        files.write(rows(spark, (name, None, "x")), f"{tmp_path}/out", ["i"])
    assert not list(tmp_path.iterdir())


def test_no_files_make_an_empty_folder(spark, tmp_path):
    files.write(rows(spark, ("a", None, "x")).where("false"), f"{tmp_path}/out", ["i"])
    assert (tmp_path / "out").is_dir() and not list((tmp_path / "out").iterdir())
    assert contents(spark, f"{tmp_path}/out") == {}


def test_files_without_bytes_are_read_too(spark, tmp_path):
    at = f"{tmp_path}/out"
    files.write(rows(spark, ("x/a", None, ""), ("b", None, None), ("c", None, "full")), at, ["i"])
    assert contents(spark, at) == {"x/a": b"", "b": b"", "c": b"full"}
