import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[*]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def series(spark):
    """Weekly rows of named value lists from Monday 2021-01-04 on."""
    import datetime as dt

    def make(**values):
        rows = [(k, dt.date(2021, 1, 4) + dt.timedelta(weeks=i), float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, "series string, ds date, y double")

    return make
