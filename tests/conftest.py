from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from logsift.plans.session import prepare

LOG = "topic string, partition int, offset bigint, value string"
CURSORS = "topic string, partition int, start bigint, end bigint, offset bigint"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture
def make_log(spark):
    """A log from (topic, partition, offset, value) rows."""
    return lambda rows, schema=LOG: spark.createDataFrame(rows, schema)


@pytest.fixture
def make_cursors(spark):
    return lambda rows: spark.createDataFrame(rows, CURSORS)


def rows(df, *columns):
    """Rows as sorted plain tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
