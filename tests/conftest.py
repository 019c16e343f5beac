import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pdcspark.session import local_session

    s = local_session("*", shuffle_partitions=8, app="pdcspark-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def hand(spark):
    from fixture import hand_fixture

    return hand_fixture(spark).cache()
