from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from helpers import TINY_DATA  # noqa: E402

from checks.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8)
    for key, value in TINY_DATA.items():
        session.conf.set(key, value)
    yield session
    session.stop()
