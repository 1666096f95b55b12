"""One local session for the whole run."""

import pytest

from quillmark.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_session("tests", cores="4")
    if s.sparkContext.getCheckpointDir() is None:
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()
