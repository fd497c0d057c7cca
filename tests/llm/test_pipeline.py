import pytest

import corpus_pipeline as P


@pytest.fixture(scope="module")
def stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in P.STAGES:
        docs = P.cut(stage(spark, docs, sf_dir))
        out.append(docs)
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), out


def test_each_stage_keeps_the_columns_and_does_its_work(spark, stages):
    docs, (known, clean, unique, mix, tokens) = stages
    for df in (known, clean, unique, mix):
        assert df.dtypes == docs.dtypes
    assert 0 < unique.count() <= clean.count() <= known.count() <= docs.count()
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    before, after = (df.join(labels.where("toxic = 1"), "doc_id").count() for df in (known, clean))
    assert after < before
    joined = P.ngram_join.ngram_join(unique)
    assert joined.where("doc_id <> component_id").isEmpty()
    assert mix.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    assert tokens.count() == mix.count() and tokens.where("not round_trip").isEmpty()


def test_odd_rows_pass_all_stages(spark, odd_docs, no_docs):
    for start in (odd_docs, no_docs):
        docs = start
        for _, stage in P.STAGES:
            docs = P.cut(stage(spark, docs, "/root/testdata/sf0.001"))
        assert docs.columns == ["doc_id", "n_tokens", "ids", "n_bytes", "round_trip"]


def test_entry_without_the_corpus_package(monkeypatch):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and "op1_embedding_dedup" in entry.queries()
    monkeypatch.setattr(entry, "_optional", lambda name: None)
    assert "ham_paths_nation" in entry.queries() and "pipeline" not in entry.queries()


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a.replace("a39", "other")
    rows = [(5, a), (5, a), (3, near), (None, a), (5, b), (7, b), (None, c), (None, c), (9, ""), (9, ""), (10, None), (11, c + " c0 c1 c2")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row_key string, times int")
    out = P.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(3, near), (5, b), (9, ""), (10, None), (11, c + " c0 c1 c2")], key=str)
