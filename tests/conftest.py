import pytest

from tests.oracle import connect, make_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = make_session("tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    return connect(SMALL)
