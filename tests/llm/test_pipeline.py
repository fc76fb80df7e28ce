import corpus_pipeline
import pytest
from tests.llm.helpers import awkward

from millrace.llm import queries

TEST_DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{TEST_DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, TEST_DATA)
        assert out.dtypes == docs.dtypes and 0 < out.count() <= docs.count()


def test_pipeline_packs_what_its_stages_keep(spark):
    from millrace.llm import scratch

    docs = spark.read.parquet(f"{TEST_DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, TEST_DATA), name.replace(" ", "-"))
    got = corpus_pipeline.run(spark, TEST_DATA)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert docs.where("n_chars <> char_length(text)").count() == 0


def test_stages_take_awkward_rows(spark):
    extra = ["lang", "source", "key"]
    docs = awkward(spark, extra).selectExpr("*", "cast(char_length(text) as long) as n_chars")
    kept = corpus_pipeline.line_filter(spark, docs, TEST_DATA)
    assert kept.columns == docs.columns and kept.count() >= 8
    assert corpus_pipeline.near_copies(spark, kept, TEST_DATA).columns == docs.columns
    assert corpus_pipeline.quality_filter(spark, docs, TEST_DATA).columns == docs.columns


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, TEST_DATA)
    assert df.count() > 0 and "doc_id" in df.columns or name in ("op6_page_text", "op9_kmeans_tree_search")
