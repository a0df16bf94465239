"""The pipeline's stages and the queries with SQL."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.oracle import assert_same, connect
from treeloom.llm import registry
from treeloom.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert_same(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name])


def test_registered():
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in registry.queries()}
    assert "pipeline" in entry.queries()


def test_stages_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SF), name)
        if name != "packing":
            assert after.columns == columns and after.schema.simpleString() == docs.schema.simpleString()
        seen[name] = (docs, after)
        docs = after
    before, after = seen["quality"]
    good = before.join(labels.where("quality = 1"), "doc_id")
    assert good.join(after, "doc_id", "left_semi").count() >= 0.97 * good.count()
    before, after = seen["near_dedup"]
    assert after.select("doc_id").distinct().count() == after.count() < before.count()


def test_stages_take_nulls_and_clashing_columns(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "a", 0, 2), (2, "some words to keep in the mix of texts", "en", "a", 38, 3), (2, "some words to keep in the mix of texts", "en", "a", 38, 3), (3, "andere Worte für diese Mischung von Texten", "de", None, 42, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long")
    for start in (docs, docs.where("false")):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = stored(stage(spark, now, SF), name)
            if name != "packing":
                assert now.columns == docs.columns
