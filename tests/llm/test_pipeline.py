import corpus_pipeline
from parlance.llm import pieces
from tests.llm.fixtures import SF, docs, labels, prose
from tests.llm.test_near_duplicates import brute as groups
from tests.llm.test_spans import brute as cut, with_hashes

SF2 = "/root/testdata/sf0.01"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "minhash near-dedup", "substring dedup", "source mixing", "sentencepiece encoding"]


def test_each_stage_against_brute_force(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    kept, one, cuts, mix, enc = (f for _, f in corpus_pipeline.STAGES)
    a = kept(spark, given, SF).cache()
    assert a.columns == given.columns and 0 < a.count() <= given.count()
    b = one(spark, a, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in a.collect()]
    assert sorted(r["doc_id"] for r in b.collect()) == sorted(i for i, _, c in groups(rows, 5, 80) if i == c)
    c = cuts(spark, b, SF).cache()
    rows = with_hashes(b)
    got = {r["doc_id"]: r for r in c.collect()}
    assert [got[r[0]]["text"] for r in rows] == cut(rows) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    d = mix(spark, c, SF).cache()
    assert d.columns == given.columns and {r["doc_id"] for r in d.collect()} <= set(got)
    e = pieces.decode(enc(spark, d, SF), pieces.vocabulary())
    assert sorted((r["doc_id"], r["decoded"]) for r in e.collect()) == sorted((r["doc_id"], r["text"]) for r in d.collect())


def test_other_columns_keep_their_values(spark):
    rows = [(i, prose(i, 60), "en", "web") for i in range(30)]
    given = docs(spark, rows)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert {tuple(r) for r in stage(spark, given, SF).select("score", "predicted", "removed_words", "copies").collect()} == {("mine",) * 4}


def test_clean_documents_stay(spark):
    given = spark.read.parquet(f"{SF2}/documents.parquet")
    good = spark.read.parquet(f"{SF2}/labels.parquet").where("quality = 1").select("doc_id")
    kept = corpus_pipeline.STAGES[0][1](spark, given, SF2)
    assert kept.join(good, "doc_id").count() >= 0.9 * given.join(good, "doc_id").count()


def test_awkward_rows_through_all_stages(spark, tmp_path):
    for k, (rows, marks) in enumerate(((None, [(1, 1, 0), (8, 0, 0), (4, 1, 0), (12, 0, 1)]), ([], []))):
        at = str(tmp_path / str(k))
        docs(spark, rows).write.parquet(f"{at}/documents.parquet")
        labels(spark, marks).write.parquet(f"{at}/labels.parquet")
        out = corpus_pipeline.run(spark, at)
        assert {"doc_id", "tokens", "n_tokens", "lossless"} <= set(out.columns)
        assert all(r["lossless"] for r in out.collect())
