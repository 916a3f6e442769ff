import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lexigrid.session import local_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=8, memory="6g", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def _release():
    yield
    release()
