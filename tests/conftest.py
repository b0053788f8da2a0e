import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from lexmill.session import get_session

    s = get_session("tests", 4)
    yield s
    s.stop()
