import os
import sys

import pytest

for _folder in (os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))):
    sys.path.insert(0, _folder)


@pytest.fixture(scope="session")
def spark():
    from blockloom.session import local_session

    session = local_session(4, "6g", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
