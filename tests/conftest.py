import os
import sys
from datetime import datetime, timedelta, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from headwise.schema import SCORES  # noqa: E402
from headwise.session import build_session  # noqa: E402

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.maxMetadataStringLength": "5000",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def scores(spark):
    """Factory of scores rows from keyword dictionaries."""
    def make(rows):
        full = []
        for i, row in enumerate(rows):
            base = {
                "id": i, "observed_ts": START + timedelta(seconds=i), "event_ts": None, "route_id": "A",
                "stop_id": "s1", "headway_sec": 100.0, "predicted_headway_sec": None, "anomaly_score": 0.0,
                "residual": None, "window_sec": 300,
            }
            base.update(row)
            full.append(tuple(base[n] for n in SCORES.fieldNames()))
        return spark.createDataFrame(full, SCORES)
    return make
