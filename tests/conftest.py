from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from corbel.session import session

    s = session(4, shuffle=4, spark__driver__memory="3g", spark__sql__warehouse__dir="/tmp/corbel-warehouse")
    yield s
    s.stop()

collect_ignore = ["fixture"]
