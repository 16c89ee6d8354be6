import pytest

from shelfmark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 2)
    yield session
