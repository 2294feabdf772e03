import pytest

from tickloom.session import local_session, prepare


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, "tickloom-tests", spark__sql__shuffle__partitions="4")
    s.sparkContext.setLogLevel("ERROR")
    if s.sparkContext.getCheckpointDir() is None:
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return prepare(s)
