import pytest
from lodestone.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, app="lodestone-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
