import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from listwright.session import STATIC_SETTINGS, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    builder = builder.config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    for key, value in STATIC_SETTINGS.items():
        builder = builder.config(key, value)
    session = prepare(builder.getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def values(spark):
    """Evaluates column expressions over one string column ``x``."""

    def run(expression, cells):
        df = spark.createDataFrame(list(enumerate(cells)), "i int, x string")
        return [r[0] for r in df.orderBy("i").select(expression).collect()]

    return run
