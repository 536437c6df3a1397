import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from donorlens.session import local_session

    session = local_session(cores="*", shuffle_partitions=8)
    yield session


@pytest.fixture(scope="session")
def tables(spark):
    from donorlens.sources import TestdataTables

    return TestdataTables.for_session(spark, SMALL)


@pytest.fixture(scope="session")
def duck_small():
    from tools.check_oracle import oracle_connection

    return oracle_connection(SMALL)
