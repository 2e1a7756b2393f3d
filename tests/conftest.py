from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import get_session

    root = tmp_path_factory.mktemp("spark")
    session = get_session("tests", cores=8, shuffle_partitions=8, spark__driver__memory="8g", spark__checkpoint__dir=f"file://{root}/shared", spark__sql__warehouse__dir=f"file://{root}/warehouse")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
