import pytest

from tickerloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(master="local[4]", shuffle_partitions=4, app="tickerloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
