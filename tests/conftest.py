import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
sys.path.insert(0, os.path.dirname(HERE))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    import oracle
    s = oracle.session()
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import oracle
    return oracle.connect(SF)


@pytest.fixture(scope="session")
def sf():
    return SF
