import pytest

from lorebase.session import session


@pytest.fixture(scope="session")
def spark():
    return session("tests", cores=4, **{"spark.sql.shuffle.partitions": "4"})
