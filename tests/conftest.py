import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from helioframe.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.log.level": "ERROR",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def curve(spark):
    """values -> light curve of one channel and day at one-second cadence."""

    def build(values, channel="soft", day="2024-01-01"):
        import datetime

        d = datetime.date.fromisoformat(day)
        rows = [(channel, d, i, 1704067200 + i, None if v is None else float(v)) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "channel string, day date, bin bigint, t bigint, v double")

    return build
