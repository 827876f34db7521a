import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from talewind.session import local_session  # noqa: E402
from talewind.sources.tables import ship_package  # noqa: E402
from talewind.spool import Spool  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, spark__sql__shuffle__partitions="4")
    ship_package(s)
    return s


@pytest.fixture
def spool(spark):
    return Spool(spark, "test")
