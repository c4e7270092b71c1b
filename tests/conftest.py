"""One local session for all tests."""

import os

import pytest

from quillon.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    s = ship(local_session(os.environ.get("TEST_CORES", "4"), 4, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}))
    s.sparkContext.setLogLevel("ERROR")
    return s
