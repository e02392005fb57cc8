import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]").appName("cardwatch-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def limits(spark):
    """Set spark.cardwatch limits for one test."""
    names = []

    def put(**values):
        for name, value in values.items():
            names.append(f"spark.cardwatch.{name}")
            spark.conf.set(names[-1], str(value))

    yield put
    for name in names:
        spark.conf.unset(name)


@pytest.fixture(scope="session")
def sf():
    return SF
