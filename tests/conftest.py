import pytest

from stayline.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


SMALL = "/root/testdata/sf0.001"
