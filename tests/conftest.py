import pytest

from tests.session import make_session


@pytest.fixture(scope="session")
def spark():
    return make_session()
