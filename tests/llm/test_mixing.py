import duckdb
from pyspark.sql import functions as F

from parlance.llm import mixing, mixing_sql
from tests.against_duckdb import from_duckdb, from_spark, ordered
from tests.llm.fixtures import SF, awkward, docs, prose


def test_registered_query_is_the_sql(spark):
    assert from_spark(mixing.query(spark, SF)) == from_duckdb(mixing_sql.SQL, SF)


def as_sql(df):
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    sql = con.execute(mixing_sql.SQL)
    return ordered([c[0] for c in sql.description], sql.fetchall())


def test_repeated_rows_draw_each_for_itself(spark):
    """Forty equal rows, and rows that share a key: taken words come as near to the target as one document allows."""
    rows = [(7, prose(7, 400), "en", "a")] * 40 + [(None, prose(9, 300), "en", "b")] * 20 + [(i // 2, prose(i, 50 + i), "en", "c") for i in range(60)] + [(None, None, "en", "b")] * 3
    df = docs(spark, rows)
    got = mixing.mixed(df)
    assert from_spark(got) == as_sql(df)
    by = {}
    for r in got.collect():
        by.setdefault(r["source"], []).append(r)
    assert len(by["a"]) == 40 and len({r["copies"] for r in by["a"]}) == 2
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert mixing.repeated(df).count() == sum(r["copies"] for own in by.values() for r in own)


def test_many_sources_by_ranges(spark, monkeypatch):
    before = mixing.before
    monkeypatch.setattr(mixing, "before", lambda df, order, sums: before(df, order, sums, most=7))
    df = docs(spark, [(i, prose(i, 5 + i % 40), "en", None if i % 50 == 0 else f"s{i % 37}") for i in range(150)])
    assert from_spark(mixing.mixed(df)) == as_sql(df)


def some(n=400):
    names = ["a", "b", None, "c", "B", "ä"]
    return [(i, prose(i, 5 + (i * 37) % 300), "en", names[0 if i % 3 == 0 else i % len(names)]) for i in range(n)]


def test_targets_and_limits(spark):
    df = docs(spark, some())
    got = mixing.mixed(df).collect()
    by = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        by.setdefault(r["source"], []).append(r)
    largest = max(r["size"] for r in got)
    total = sum(r["size"] for r in got)
    assert abs(sum(own[0]["target"] for own in by.values()) - total) < 1e-6 * total
    for own in by.values():
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert own[0]["target"] <= 3 * own[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= largest
    assert from_spark(mixing.mixed(df)) == as_sql(df)


def test_reruns_agree_and_rows_repeat_as_often_as_taken(spark):
    df = docs(spark, some(120))
    one, two = (sorted(tuple(r) for r in mixing.mixed(x).select("doc_id", "copies").collect()) for x in (df, df.repartition(7)))
    assert one == two
    rows = dict(mixing.repeated(df).groupBy("doc_id").count().collect())
    assert rows == {i: c for i, c in one if c}
    assert mixing.repeated(df).columns == df.columns


def test_awkward_rows(spark):
    got = mixing.mixed(docs(spark)).collect()
    assert len(got) == len(awkward())
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.repeated(docs(spark)).where(F.col("text").isNull()).count() == 0


def test_empty_table(spark):
    assert mixing.mixed(docs(spark, [])).count() == 0 and mixing.repeated(docs(spark, [])).count() == 0
