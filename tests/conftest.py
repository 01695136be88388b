import pytest

from pactframe.plans import load
from pactframe.session import local_session


@pytest.fixture(scope="session")
def spark():
    load()
    session = local_session("8", 4)
    yield session
    session.stop()
