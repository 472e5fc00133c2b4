import pytest

from veridraft.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
