import tempfile

import pytest

from listingmart.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cpus="8")


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-")
