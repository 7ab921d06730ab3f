import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from registry.compare import session


@pytest.fixture(scope="session")
def spark():
    s = session(partitions="4")
    yield s
    s.stop()
