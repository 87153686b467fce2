import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from tideline.session import drop_cuts, local_session

    session = local_session("8", partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    drop_cuts(session)
    session.stop()
