import pytest

from quillrake.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session(4, "4g", "tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
