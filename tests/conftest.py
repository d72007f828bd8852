import pytest


@pytest.fixture(scope="session")
def spark():
    from turnstile.session import local_session

    return local_session(2)
