"""All queries on Parquet files without rows, which the optimizer can't fold away."""

import pytest

import corpus_pipeline
from seepage.llm.queries import QUERIES

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "labels": "doc_id long, quality long, toxic long",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_no_rows(spark, folder, name):
    query = {**QUERIES, "pipeline": corpus_pipeline.run}[name]
    assert query(spark, folder).collect() == []
