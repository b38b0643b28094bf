import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw_row():
    """A raw ledger row with any fields replaced."""

    def build(**changes):
        row = {
            "step": 1,
            "type": "PAYMENT",
            "amount": "10.00",
            "nameorig": "C1",
            "oldbalanceorg": "100.00",
            "newbalanceorig": "90.00",
            "namedest": "M1",
            "oldbalancedest": "0.00",
            "newbalancedest": "0.00",
            "isfraud": 0,
            "isflaggedfraud": 0,
        }
        row.update(changes)
        return row

    return build


@pytest.fixture(scope="session")
def ledger(spark, raw_row):
    """A raw ledger from a list of changes, money as text."""
    schema = (
        "step int, type string, amount string, nameorig string, oldbalanceorg string, "
        "newbalanceorig string, namedest string, oldbalancedest string, "
        "newbalancedest string, isfraud int, isflaggedfraud int"
    )

    def build(*rows):
        return spark.createDataFrame([raw_row(**r) for r in rows], schema)

    return build


@pytest.fixture()
def many_blocks(spark):
    """Keep small shuffle partitions apart, so that layouts have several blocks."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)
