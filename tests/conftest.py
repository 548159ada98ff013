import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, shuffle_partitions=4, memory="6g", app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def star(spark):
    """The driver's smallest tables, stored once so that every test reads the same rows."""
    from ledgerlens.session import materialize
    from ledgerlens.sources.views import Star
    from ledgerlens.sources.views import star as build

    s = build(spark, SF)
    return Star(materialize(s.transactions, "t"), s.customers, s.accounts, s.merchants, s.locations)


@pytest.fixture(scope="session")
def data(star):
    from ledgerlens.config import THIRTY_DAYS
    from ledgerlens.operators.dataset import make_dataset

    return make_dataset(star, THIRTY_DAYS)
