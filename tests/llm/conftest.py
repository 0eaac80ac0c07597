import pytest

CLASH = ["size", "rep", "n", "token", "copies", "grp", "toxic", "severity", "score", "_n", "_key", "host", "bucket"]


@pytest.fixture
def documents(spark):
    """Factory for documents from (doc_id, text[, lang, source]) with columns of clashing names."""

    def make(*rows, partitions=3):
        full = [(*row, None, None)[:4] for row in rows]
        extra = ", ".join(f"{c} string" for c in CLASH)
        return spark.createDataFrame(
            [(*r, None if r[1] is None else len(r[1]), *["x"] * len(CLASH)) for r in full],
            f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(partitions)

    return make


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
