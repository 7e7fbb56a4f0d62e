import pytest

from leafmill.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("checkpoint"))
    return local_session(4, "tests", spark__checkpoint__dir=folder)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
