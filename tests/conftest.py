import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from palimp.session import get_session, ship

    s = get_session("4", "tests", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}")
    ship(s)
    yield s
    s.stop()
