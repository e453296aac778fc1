"""What the plans look like: no Python in native operators, no columns read that are not needed."""

import re

import pytest

from onoma.llm import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    docs = [(n, f"Some words of document {n}, mail a{n}@b.org\nA line that everybody repeats here", "en", "s", 60) for n in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(0, "a benchmark item of some words")], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    spark.createDataFrame([(n, n % 2, 0) for n in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op2_sharding", "op3_pii", "op7_line_dedup"])
def test_native(spark, tables, name):
    df = queries.QUERIES[name](spark, tables)
    assert not re.search("Python|Pandas|Arrow", plan(df))
    assert len(df.collect()) == 40


@pytest.mark.parametrize("name", ["op1_bpe", "op4_quality", "op5_kneser_ney", "op8_media", "op9_language_id", "op10_decontamination"])
def test_documents_stay_where_they_are(spark, tables, name):
    p = plan(queries.QUERIES[name](spark, tables))
    assert "Exchange" not in p and "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_every_query_is_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
