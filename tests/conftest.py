import pytest

from tidemark.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = "file://" + str(tmp_path_factory.mktemp("shared"))
    session = get_session(cpus=4, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": shared, "spark.driver.memory": "4g"})
    yield session
