import pytest

from orbitweave.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=8, partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
