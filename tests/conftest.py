from __future__ import annotations

import pytest

from loupe.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=8, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
