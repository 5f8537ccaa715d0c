import os
import sys
from datetime import date, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gaugeflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("gaugeflow-tests", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """DataFrame from rows; dates may be given as offsets from a first day."""

    def build(rows, schema):
        return spark.createDataFrame(rows, schema)

    return build


def day(n, start=date(2000, 10, 1)):
    return start + timedelta(days=n)


def collect(df, *order):
    rows = [r.asDict() for r in df.collect()]
    return sorted(rows, key=lambda r: tuple(str(r[c]) if not isinstance(r[c], (int, float)) else r[c] for c in order))
