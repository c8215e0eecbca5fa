import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from chainsieve.session import build_session

    return build_session("tests", "local[8]", 8)


@pytest.fixture(scope="session")
def tables(spark):
    from chainsieve.tables import Tables

    return Tables(spark, TINY)
