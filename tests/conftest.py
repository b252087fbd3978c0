import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def conf(spark):
    """Sets spark.jev.* settings for one test."""
    used = []

    def put(**values):
        for k, v in values.items():
            key = f"spark.jev.{k.replace('_', '.')}"
            spark.conf.set(key, v)
            used.append(key)

    yield put
    for key in used:
        spark.conf.unset(key)
