import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").appName("spandoc-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def hot(spark):
    """Every entity above three rows takes the chunked path."""
    spark.conf.set("spandoc.hotKeyRows", "3")
    yield
    spark.conf.unset("spandoc.hotKeyRows")


@pytest.fixture(scope="session")
def spans_of(spark):
    def make(rows, scheme_cols="entity_id string, k bigint, start_at bigint, end_at bigint, label string"):
        return spark.createDataFrame(rows, scheme_cols)

    return make


@pytest.fixture(scope="session")
def entities_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "entity_id string, char_count bigint, split string")

    return make
