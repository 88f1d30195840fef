import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from fieldlab.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[8]").appName("fieldlab-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield configure(s)
    s.stop()


@pytest.fixture
def rows():
    """Sorted list of plain tuples of a table."""
    def collect(df):
        key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
        return sorted((tuple(r) for r in df.collect()), key=key)
    return collect
