import pytest

from tests.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("4", partitions=3)
