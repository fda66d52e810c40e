import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from sitegauge.session import local_session, share_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    share_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def smallest():
    return "/root/testdata/sf0.001"
