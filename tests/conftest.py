import pytest

from tessera.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cpus=4, shuffle_partitions=4, memory="4g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()
