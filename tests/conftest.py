import pytest

from tickerloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", shuffle_partitions=4, memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    return session
