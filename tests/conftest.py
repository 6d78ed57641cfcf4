import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from listingloom import prepare  # noqa: E402
from listingloom.schema import LISTING  # noqa: E402
from listings_data import FIVE, listing  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("listingloom-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Listing rows to a DataFrame."""

    def make(rows):
        return spark.createDataFrame(list(rows), LISTING)

    return make


@pytest.fixture(scope="session")
def five(frame):
    return frame(
        listing(i, c, [place], [term], s, active, True, posted)
        for i, c, place, term, s, active, posted in FIVE
    )
