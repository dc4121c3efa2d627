import pytest

from glyphmill.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
