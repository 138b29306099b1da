import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from skarn.session import session

    s = session(4, 4, "6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
