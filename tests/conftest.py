import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from qualitas.session import local_session
    s = local_session("*", shuffle_partitions=8, app="qualitas-tests")
    yield s


@pytest.fixture(scope="session")
def dirty01(spark):
    from qualitas.sources.tables import load_dirty_payments
    return load_dirty_payments(spark, SF01).cache()
