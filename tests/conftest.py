import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from paperloom.session import build_session, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = tune(build_session("tests", "4", 4, "4g"))
    yield session
    session.stop()
