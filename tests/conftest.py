import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gridroll.session import local_session, ship

    s = local_session(4, 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s


@pytest.fixture
def data():
    return "/root/testdata/sf0.001"
