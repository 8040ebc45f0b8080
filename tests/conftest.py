from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from compare import session

    from pagefacts.session import tune

    s = session()
    s.sparkContext.setLogLevel("ERROR")
    yield tune(s)
    s.stop()
