import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture
def responses(spark):
    """Factory for captures: (target, url, status, body[, headers])."""

    def make(*rows):
        full = [(*row, None)[:5] if len(row) == 4 else row for row in rows]
        return spark.createDataFrame(
            [(t, u, s, b, h, None, None) for t, u, s, b, h in full],
            "target string, url string, status int, body string, headers map<string,string>, "
            "cookies map<string,string>, fetched_at timestamp",
        )

    return make
