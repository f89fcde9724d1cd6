import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)

from compare import open_tables, session  # noqa: E402

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = session()
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return TABLES


@pytest.fixture(scope="session")
def sql(sf_dir):
    return open_tables(sf_dir)


READING = """timestamp string, device_id string, device_type string, location string, status string, msg_id long,
temperature double, pressure double, humidity double, battery_level double"""


@pytest.fixture(scope="session")
def readings(spark):
    """Builds an events frame from short tuples: (time, device, status, id, temperature, pressure)."""

    def build(rows, device_type="multi-sensor"):
        full = [
            (t, d, device_type, "lobby", s, i, temp, press, 50.0, 80.0) for t, d, s, i, temp, press in rows
        ]
        df = spark.createDataFrame(full, READING)
        return df.withColumn("timestamp", df["timestamp"].cast("timestamp_ntz"))

    return build
