import pytest

from loomcert.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", 8, "6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
