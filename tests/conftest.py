import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from corvane.context import build_session, ship

    session = build_session("local[4]", "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
