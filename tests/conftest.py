import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

from ledgerfold.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*")
    yield session
    session.stop()
