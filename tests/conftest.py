import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from bankspark.session import local_session

    session = local_session("tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("BANKSPARK_TESTDATA", "/root/testdata") + "/sf0.001"


@pytest.fixture(scope="session")
def bank(spark, folder):
    from bankspark.sources.tables import Bank

    return Bank(spark, folder)
